"""Columns of nested statements, against a table written by hand.

Each use is "scope[.branch] clause table.column[=other.column]"; ``@n`` is the
sub-query that defines a table, tables keep the schema they are written with.
"""

from stmtwarden.functions.scopes import scoped_columns, statement_scopes

CASES = [
    # sub-queries in conditions
    ("select a from t where b = 1", "0 select t.a|0 table t|0 where t.b"),
    ("select a from t where b in (select x from u)", "0 select t.a|0 table t|0 where t.b|1 select u.x|1 table u"),
    ("select a from t where b = (select max(x) from u where y > 2)", "0 select t.a|0 table t|0 where t.b|1 select u.x|1 table u|1 where u.y"),
    ("select a from t where not exists (select 1 from u where u.k = t.k)", "0 select t.a|0 table t|1 table u|1 where u.k=t.k"),
    ("select a from t x where exists (select 1 from u where u.k = x.k)", "0 select t.a|0 table t|1 table u|1 where u.k=t.k"),
    (
        "select a from t where b in (select x from u where y in (select z from v where w = 1))",
        "0 select t.a|0 table t|0 where t.b|2 select u.x|2 table u|2 where u.y|1 select v.z|1 table v|1 where v.w",
    ),
    (
        "select a from t where exists (select 1 from u where exists (select 1 from v where v.p = t.p and v.q = u.q))",
        "0 select t.a|0 table t|2 table u|1 table v|1 where v.p=t.p|1 where v.q=u.q",
    ),
    (
        "select a from t where b in (select x from u) and c in (select y from v)",
        "0 select t.a|0 table t|0 where t.b|0 where t.c|1 select u.x|1 table u|2 select v.y|2 table v",
    ),
    ("select a from t where b > all (select x from u where u.m = 'q')", "0 select t.a|0 table t|1 select u.x|1 table u|1 where u.m|0 where t.b"),
    # the inner level hides the outer one
    ("select a from t x where exists (select 1 from u x where x.k = 1)", "0 select t.a|0 table t|1 table u|1 where u.k"),
    ("select a from t where b in (select b from t where c = 1)", "0 select t.a|0 table t|0 where t.b|1 select t.b|1 table t|1 where t.c"),
    # sub-queries in the select list
    ("select a, (select max(x) from u where u.k = t.k) m from t", "0 select t.a|0 table t|1 select u.x|1 table u|1 where u.k=t.k"),
    ("select (select 1 from u where p = 2) from t where q = 3", "0 table t|0 where t.q|1 table u|1 where u.p"),
    # derived tables
    ("select d.a from (select a, b from t where c = 1) d where d.b = 2", "0 select @1.a|0 table @1|0 where @1.b|1 select t.a|1 select t.b|1 table t|1 where t.c"),
    ("select a from (select a from t) as d", "0 select @1.a|0 table @1|1 select t.a|1 table t"),
    (
        "select d.a from r join (select a, k from t) d on d.k = r.k where r.z = 1",
        "0 select @1.a|0 table r|0 table @1|0 join @1.k=r.k|0 where r.z|1 select t.a|1 select t.k|1 table t",
    ),
    ("select a from (select a from (select a from t where b = 1) i) o", "0 select @2.a|0 table @2|2 select @1.a|2 table @1|1 select t.a|1 table t|1 where t.b"),
    # a derived table does not see those beside it, a lateral one does
    ("select 1 from r, (select x from t where r.k = 1) d", "0 table r|0 table @1|1 select t.x|1 table t|1 where .k"),
    ("select 1 from r, lateral (select x from t where t.k = r.k) d", "0 table r|0 table @1|1 select t.x|1 table t|1 where t.k=r.k"),
    # common tables
    ("with d as (select a from t where b = 1) select a from d", "0 select @1.a|0 table @1|1 select t.a|1 table t|1 where t.b"),
    ("with d as (select a from t) select d.a from d join u on d.a = u.k", "0 select @1.a|0 table @1|0 table u|0 join u.k=@1.a|1 select t.a|1 table t"),
    (
        "with d as (select a from t), e as (select a from d where a > 1) select x.a from e x",
        "0 select @2.a|0 table @2|1 select t.a|1 table t|2 select @1.a|2 table @1|2 where @1.a",
    ),
    ("with d (p) as (select a from t) select p from d where p = 4", "0 select @1.p|0 table @1|0 where @1.p|1 select t.a|1 table t"),
    ("with d as (select a from t) select k from u where k in (select a from d)", "0 select u.k|0 table u|0 where u.k|1 select t.a|1 table t|2 select @1.a|2 table @1"),
    ("select k from u where k in (with d as (select a from t) select a from d)", "0 select u.k|0 table u|0 where u.k|1 select t.a|1 table t|2 select @1.a|2 table @1"),
    # sets
    ("select a from t where b = 1 union select x from u where y = 2", "0 select t.a|0 table t|0 where t.b|0.1 select u.x|0.1 table u|0.1 where u.y"),
    ("select a from t union all select x from u order by x", "0 select t.a|0 table t|0.1 select u.x|0.1 table u|0.1 order u.x"),
    (
        "select a from t union select x from u where y in (select z from v where v.k = u.k)",
        "0 select t.a|0 table t|0.1 select u.x|0.1 table u|0.1 where u.y|1 select v.z|1 table v|1 where v.k=u.k",
    ),
    ("select a from t where b in (select x from u union select y from v)", "0 select t.a|0 table t|0 where t.b|1 select u.x|1 table u|1.1 select v.y|1.1 table v"),
    ("(select a from t) union (select b from u)", "1 select t.a|1 table t|2 select u.b|2 table u"),
    # changes of rows
    ("update t set a = 1 where b in (select x from u where y = 2)", "0 set t.a|0 table t|0 where t.b|1 select u.x|1 table u|1 where u.y"),
    ("delete from t where b in (select x from u)", "0 table t|0 where t.b|1 select u.x|1 table u"),
    ("insert into t (a) select x from u where y in (select z from v)", "0 insert t.a|0 table u|0 where u.y|1 select v.z|1 table v"),
    # schemas
    ("select a from db1.t where b = 1", "0 select db1.t.a|0 table db1.t|0 where db1.t.b"),
    ("select t.a from db1.t where t.b in (select x from db2.t)", "0 select db1.t.a|0 table db1.t|0 where db1.t.b|1 select db2.t.x|1 table db2.t"),
    ("select 1 from db1.t x join db2.t y on x.k = y.k", "0 table db1.t|0 table db2.t|0 join db2.t.k=db1.t.k"),
    # a constant on the left
    ("select a from t where 5 < b and 'x' = c", "0 select t.a|0 table t|0 where t.b|0 where t.c"),
    ("select a from t where (1 <= b or ? <> c)", "0 select t.a|0 table t|0 where t.b|0 where t.c"),
    # what must not be taken for a level
    ("select count(a) from t where b in (1, (2)) and c = 'in (select x from u)'", "0 select t.a|0 table t|0 where t.b|0 where t.c"),
    ("select a /* (select x from u) */ from t where lower(trim(b)) = 'z'", "0 select t.a|0 table t|0 where t.b"),
]


def shown(r):
    name = lambda schema, table, scope: f"@{scope}" if scope is not None else ".".join(x for x in (schema, table) if x)
    place = str(r.scope) + (f".{r.branch}" if r.branch else "")
    use = name(r.schema_name, r.table_name, r.derived_scope) + (f".{r.column_name}" if r.column_name else "")
    other = f"={name(r.other_schema, r.other_table, r.other_scope)}.{r.other_column}" if r.literal_kind == "column" else ""
    return f"{place} {r.clause} {use}{other}"


def test_columns_of_every_level(spark):
    df = spark.createDataFrame([(n, sql) for n, (sql, _) in enumerate(CASES)], "id int, sql_text string")
    got = {}
    for r in scoped_columns(df).filter("clause <> 'alias'").collect():
        got.setdefault(r.id, []).append(shown(r))
    wrong = [(sql, sorted(got.get(n, [])), sorted(want.split("|"))) for n, (sql, want) in enumerate(CASES) if sorted(got.get(n, [])) != sorted(want.split("|"))]
    assert not wrong, "\n".join(map(str, wrong))
    assert len(CASES) == 40


def test_signs_turn_with_their_sides(spark):
    df = spark.createDataFrame([(1, "select a from t where 5 < b and 6 >= c and 7 <=> d and 8 <> e and 9 = f")], "id int, sql_text string")
    got = {r.column_name: r.operator for r in scoped_columns(df).filter("clause = 'where'").collect()}
    assert got == {"b": ">", "c": "<=", "d": "<=>", "e": "<>", "f": "="}


def test_odd_texts_and_no_shuffle(spark):
    texts = [None, "", "select", "select a from t where (b = 1", "select a from t) where b = 1", "drop table t", "select a from t where " + "(" * 60 + "b = 1" + ")" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sql_text string")
    found = scoped_columns(df)
    assert {r.id for r in found.collect()} == {3, 4, 6}
    assert {(r.column_name, r.scope) for r in found.filter("id = 6 AND clause = 'where'").collect()} == {("b", 0)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert scoped_columns(df.limit(0)).count() == 0


def test_levels_know_their_parents(spark):
    df = spark.createDataFrame([(1, "select a from t where b in (select x from u where y in (select z from v)) and c in (select k from w)")], "id int, sql_text string")
    got = {(r.scope, r.parent, r.bare[-1]) for r in statement_scopes(df).select("scope", "parent", "bare").collect()}
    assert {(s, p) for s, p, _ in got} == {(0, None), (1, 3), (2, 0), (3, 0)}


def test_levels_are_worked_out_once(spark):
    """No filter below the levels' columns repeats what they are made of."""
    found = statement_scopes(spark.createDataFrame([(1, "SELECT a FROM (SELECT b FROM t WHERE 5 > c) x")], "id int, sql_text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("[")[0].split("(")[0] and "transform(" in line]
    assert {(r.scope, r.bare) for r in found.collect()} == {(0, "SELECT a FROM (@1) x"), (1, "SELECT b FROM t WHERE c < 5")}
