"""Fingerprints, comments, keys and statement pieces on small statements."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stmtwarden.functions import keys, text
from stmtwarden.functions.statement_columns import statement_columns, statement_tables


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, sql_text string")
    return [r[0] for r in df.orderBy("id").select(fn(F.col("sql_text"))).collect()]


FINGERPRINTS = [
    ("select * from t where a=1", "SELECT * FROM t WHERE a = ?"),
    ("SELECT  *\nFROM t -- note\nWHERE a = 2;", "SELECT * FROM t WHERE a = ?"),
    ("select /* hint */ a from t where b='x;y'", "SELECT a FROM t WHERE b = ?"),
    ("insert into T values (1, 'it''s', \"q\", 0x1F, 1.5e-3)", "INSERT INTO T VALUES ( ? , ? , ? , ? , ? )"),
    (r"select 'a\'b' , c1 from t1", "SELECT ? , c1 FROM t1"),
    ("select '-- no comment' from `my table`", "SELECT ? FROM `my table`"),
    ("update t set a=-1 where b<=.5", "UPDATE t SET a = - ? WHERE b <= ?"),
    ("select ähnlich from größe", "SELECT ähnlich FROM größe"),
    ("select now(), cast(a as signed), if(b, 1, 2)", "SELECT NOW ( ) , CAST ( a AS signed ) , IF ( b , ? , ? )"),
    ("SELECT NOW(), CAST(a AS signed), IF(b, 3, 4)", "SELECT NOW ( ) , CAST ( a AS signed ) , IF ( b , ? , ? )"),
    ("insert into tab (a) values (lower('x'))", "INSERT INTO tab ( a ) VALUES ( LOWER ( ? ) )"),
    ("insert into db.tab (a) select b from u", "INSERT INTO db . tab ( a ) SELECT b FROM u"),
    ("create index idx_a on tab (a)", "CREATE INDEX idx_a ON tab ( a )"),
    ("select a from t join u on lower(t.x) = u.y", "SELECT a FROM t JOIN u ON LOWER ( t . x ) = u . y"),
    ("create table if not exists tab (a int, key idx (a))", "CREATE TABLE IF NOT EXISTS tab ( a INT , KEY idx ( a ) )"),
    ("with d (p) as (select 1) select `f` (p), date_format(p, 'x') from d", "WITH d ( p ) AS ( SELECT ? ) SELECT `f` ( p ) , DATE_FORMAT ( p , ? ) FROM d"),
    ("select a from t where x regexp 'a' order by b", "SELECT a FROM t WHERE x REGEXP ? ORDER BY b"),
    ("", ""),
    ("/* only a comment */", "/* only a comment */"),
]


def test_fingerprints(spark):
    got = one(spark, text.fingerprint, *[a for a, _ in FINGERPRINTS])
    assert got == [b for _, b in FINGERPRINTS]


def test_fingerprint_upper_names(spark):
    assert one(spark, lambda c: text.fingerprint(c, upper_names=True), "select A from db1.t1") == ["SELECT A FROM DB1 . T1"]


def test_fingerprint_of_a_long_literal(spark):
    """A literal of a megabyte with many escapes neither fails nor is cut."""
    body = "ab\\'c" * 200_000
    assert one(spark, text.fingerprint, f"select '{body}' from t") == ["SELECT ? FROM t"]


def test_strip_comments(spark):
    assert one(spark, text.strip_comments, "a /* x\ny */ b -- c\n d; e") == ["a b d"]


@pytest.mark.parametrize(
    "sql, kind",
    [("select 1", "DQL"), ("(select 1) union (select 2)", "DQL"), ("/* x */ insert into t values (1)", "DML"), ("replace into t values (1)", "DML"),
     ("create table t (a int)", "DDL"), ("nonsense", "DDL"), ("with x as (select 1) select * from x", "DQL")],
)
def test_sql_kind(spark, sql, kind):
    assert one(spark, text.sql_kind, sql) == [kind]


def test_sql_id_is_md5_of_the_json(spark):
    want = hashlib.md5(
        b'{"ProjectId":"p","Fingerprint":"a \\u003c \\"?\\"","Schema":"s","InstID":"i","Source":"slow_log","AuditPlanID":"1"}'
    ).hexdigest()
    lit = F.lit
    got = spark.range(1).select(keys.sql_id(lit("p"), lit('a < "?"'), lit("s"), lit("i"), lit("slow_log"), lit("1"))).first()[0]
    assert got == want


def test_referenced_tables(spark):
    df = spark.createDataFrame(
        [(1, "select * from a join `db2`.`b` on a.x = b.x where a.y in (select y from c)", "db1"), (2, "drop table d", "db1"), (3, "insert into e select * from e", "db1")],
        "id int, sql_text string, schema_name string",
    )
    got = {tuple(r) for r in text.referenced_tables(df).collect()}
    assert got == {(1, "db1", "a"), (1, "db2", "b"), (1, "db1", "c"), (3, "db1", "e")}


def columns_of(spark, sql):
    df = spark.createDataFrame([(1, sql)], "id int, sql_text string")
    return statement_columns(df).collect()


def test_columns_by_alias_and_driven_side(spark):
    rows = columns_of(spark, "select x.a from t1 x left join t2 as y on x.id = y.ref where y.c like '%z' and lower(x.b) = 'q' order by x.a desc")
    by = {(r.clause, r.column_name): r for r in rows if r.column_name}
    assert by["join", "ref"].table_name == "t2" and by["join", "ref"].other_table == "t1"
    assert by["where", "c"].operator == "LIKE" and by["where", "c"].table_name == "t2"
    assert by["where", "b"].function == "LOWER" and by["where", "b"].literal_kind == "string"
    assert by["order", "a"].operator == "DESC"
    assert [r.table_name for r in rows if r.clause == "table"] == ["t1", "t2"]


def test_subquery_columns_stay_out(spark):
    rows = columns_of(spark, "select a from t where b in (select x from u where y in (select z from v where w = 1)) and c > 5")
    assert {r.column_name for r in rows if r.clause == "where"} == {"b", "c"}


def test_update_and_insert(spark):
    rows = columns_of(spark, "update t set a = 1, b = 'x' where c = 2")
    assert {(r.clause, r.column_name, r.literal_kind) for r in rows if r.column_name} == {("set", "a", "number"), ("set", "b", "string"), ("where", "c", "number")}
    rows = columns_of(spark, "insert into t (a, b) select c, d from u where e = 1")
    assert {(r.clause, r.table_name, r.column_name) for r in rows if r.column_name} == {("insert", "t", "a"), ("insert", "t", "b"), ("where", "u", "e")}


def test_ddl_has_no_columns(spark):
    assert columns_of(spark, "create index i on t (a, b)") == []
    df = spark.createDataFrame([(1, "drop table t")], "id int, sql_text string")
    assert statement_tables(df).count() == 0
