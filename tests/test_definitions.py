"""Definitions read out of CREATE and ALTER texts, and the rules they break."""

import pytest

from stmtwarden.functions import definitions as D
from stmtwarden.lint import catalog_rules
from stmtwarden.lint.ddl_rules import audit_definitions

BASKET = """CREATE TABLE if not exists `shop`.`basket` (
 id bigint(20) unsigned NOT NULL AUTO_INCREMENT COMMENT "key, of (it)",
 name varchar(64) CHARACTER SET latin1 COLLATE latin1_bin DEFAULT 'it''s, (x)' COMMENT 'n',
 price decimal(10, 2) DEFAULT 0.5, kind enum('a','b)') NOT NULL,
 made datetime(3) NOT NULL DEFAULT CURRENT_TIMESTAMP(3) ON UPDATE CURRENT_TIMESTAMP(3), -- a note, (with) signs
 code char(4) UNIQUE, note text DEFAULT NULL,
 PRIMARY KEY (id, name(10)), UNIQUE KEY uniq_a (name, `price`), KEY (made), CONSTRAINT fk FOREIGN KEY (code) REFERENCES o (c), FULLTEXT INDEX ft (name)
) ENGINE=MyISAM AUTO_INCREMENT=3 DEFAULT CHARSET=utf8mb4 COMMENT='many, (things)' PARTITION BY RANGE (id)
 (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN MAXVALUE);"""


def defined(spark, *sql):
    return D.definitions(spark.createDataFrame(list(enumerate(sql)), "id int, sql_text string"))


def test_columns_of_a_table(spark):
    rows = D.defined_columns(defined(spark, BASKET)).orderBy("ordinal").collect()
    assert [(r.column_name, r.data_type, r.column_width) for r in rows] == [
        ("id", "bigint", 20), ("name", "varchar", 64), ("price", "decimal", 10), ("kind", "enum", None), ("made", "datetime", 3), ("code", "char", 4), ("note", "text", None),
    ]
    by = {r.column_name: r for r in rows}
    assert [r.column_name for r in rows if r.is_primary_key] == ["id", "name"]
    assert [r.column_name for r in rows if r.is_nullable] == ["price", "code", "note"]
    assert by["id"].is_unsigned and by["id"].is_auto_increment and by["id"].column_comment == "key, of (it)"
    assert (by["name"].default_value, by["name"].charset, by["name"].collation_name) == ("it's, (x)", "latin1", "latin1_bin")
    assert (by["made"].default_value, by["made"].extra) == ("CURRENT_TIMESTAMP", "on update CURRENT_TIMESTAMP")
    assert by["price"].default_value == "0.5" and by["note"].default_value is None and by["code"].column_comment == ""
    assert {(r.schema_name, r.table_name) for r in rows} == {("shop", "basket")}


def test_table_and_indexes(spark):
    found = defined(spark, BASKET)
    t = D.defined_tables(found).first()
    assert (t.engine, t.charset, t.table_comment, t.is_partitioned, t.auto_increment_start, t.has_foreign_key) == ("MyISAM", "utf8mb4", "many, (things)", True, 3, True)
    got = {(r.index_name, r.seq, r.column_name, r.is_unique, r.index_type, r.constraint_type) for r in D.defined_indexes(found).collect()}
    assert got == {
        ("PRIMARY", 1, "id", True, "BTREE", "PRIMARY KEY"), ("PRIMARY", 2, "name", True, "BTREE", "PRIMARY KEY"), ("code", 1, "code", True, "BTREE", "INDEX"),
        ("uniq_a", 1, "name", True, "BTREE", "INDEX"), ("uniq_a", 2, "price", True, "BTREE", "INDEX"), ("made", 1, "made", False, "BTREE", "INDEX"),
        ("ft", 1, "name", False, "FULLTEXT", "INDEX"),
    }


def test_changes_of_a_table(spark):
    found = defined(
        spark,
        "alter table t add column a int not null default 5 comment 'x' first, modify b char(30), change c d text, drop column z, add (e int, f bool), engine = innodb",
        "alter table db.t add primary key (a), add constraint c1 unique (b), add index using btree (k), add unique index uq (a, b(5) desc), rename index p to q",
        "create unique index i on db.t (a, b)",
    )
    assert {(r.id, r.column_name, r.data_type) for r in D.defined_columns(found).collect()} == {(0, "a", "int"), (0, "b", "char"), (0, "d", "text"), (0, "e", "int"), (0, "f", "tinyint")}
    got = {(r.id, r.index_name, r.seq, r.column_name, r.is_unique) for r in D.defined_indexes(found).collect()}
    assert got == {(1, "PRIMARY", 1, "a", True), (1, "c1", 1, "b", True), (1, "k", 1, "k", False), (1, "uq", 1, "a", True), (1, "uq", 2, "b", True), (2, "i", 1, "a", True), (2, "i", 2, "b", True)}
    assert D.defined_tables(found).count() == 0


def test_odd_texts(spark):
    found = defined(spark, None, "", "select 1", "create table", "drop table t", "create view v as select a from t", "create table x like y", "create table x (id int")
    assert {(r.id, r.column_name) for r in D.defined_columns(found).collect()} == {(7, "id")}
    assert D.defined_indexes(found).count() == 0 and found.limit(0).count() == 0
    wide = "create table w (" + ", ".join(f"c{i} decimal(10, {i % 5}) default (round({i}, 1)) comment 'a, b ({i}'" for i in range(600)) + ")"
    rows = D.defined_columns(defined(spark, wide)).collect()
    assert len(rows) == 600 and {r.data_type for r in rows} == {"decimal"} and {r.column_width for r in rows} == {10}


# Statement, rule, whether it breaks it.
CASES = [
    ("create table a (v int)", "ddl_check_pk_not_exist", True),
    ("create table a (v int primary key)", "ddl_check_pk_not_exist", False),
    ("create table a (v int, primary key (v))", "ddl_check_pk_not_exist", False),
    ("alter table a add column w int", "ddl_check_pk_not_exist", False),
    ("create table a (v int primary key)", "ddl_check_pk_without_auto_increment", True),
    ("create table a (v int auto_increment, primary key (v))", "ddl_check_pk_without_auto_increment", False),
    ("create table a (v int auto_increment primary key)", "ddl_check_pk_without_bigint_unsigned", True),
    ("create table a (v bigint unsigned auto_increment primary key)", "ddl_check_pk_without_bigint_unsigned", False),
    ("create table a (v int, w char(21))", "ddl_check_column_char_length", True),
    ("create table a (v int, w char(20))", "ddl_check_column_char_length", False),
    ("alter table a add column w char(21)", "ddl_check_column_char_length", True),
    ("alter table a modify w char(20)", "ddl_check_column_char_length", False),
    ("create table a (v int, key i1 (v), key i2 (v), key i3 (v), key i4 (v), key i5 (v))", "ddl_check_index_count", False),
    ("create table a (v int, key i1 (v), key i2 (v), key i3 (v), key i4 (v), key i5 (v), key i6 (v))", "ddl_check_index_count", True),
    ("create table a (v int, w int, x int, y int, key idx_a (v, w, x))", "ddl_check_composite_index_max", False),
    ("create table a (v int, w int, x int, y int, key idx_a (v, w, x, y))", "ddl_check_composite_index_max", True),
    ("alter table a add index idx_a (v, w, x, y)", "ddl_check_composite_index_max", True),
    ("create index idx_a on a (v, w, x, y)", "ddl_check_composite_index_max", True),
    ("create index idx_a on a (v)", "ddl_check_index_prefix", False),
    ("create index by_v on a (v)", "ddl_check_index_prefix", True),
    ("create unique index by_v on a (v)", "ddl_check_unique_index_prefix", True),
    ("alter table a add unique uniq_v (v)", "ddl_check_unique_index_prefix", False),
    ("create table a (v int comment 'x')", "ddl_check_column_without_comment", False),
    ("create table a (v int comment '')", "ddl_check_column_without_comment", True),
    ("create table a (v int default 0)", "ddl_check_column_without_default", False),
    ("create table a (v int)", "ddl_check_column_without_default", True),
    ("create table a (v blob)", "ddl_check_column_without_default", False),
    ("create table a (v timestamp)", "ddl_check_column_timestamp_without_default", True),
    ("create table a (v timestamp default now())", "ddl_check_column_timestamp_without_default", False),
    ("create table a (v blob not null)", "ddl_check_column_blob_with_not_null", True),
    ("create table a (v blob)", "ddl_check_column_blob_with_not_null", False),
    ("create table a (v text default ('x'))", "ddl_check_column_blob_default_is_not_null", True),
    ("create table a (v enum('x','y'))", "ddl_check_column_enum_notice", True),
    ("create table a (v set('x','y'))", "ddl_check_column_set_notice", True),
    ("create table a (v double)", "ddl_check_decimal_type_column", True),
    ("create table a (v varchar(1025))", "ddl_check_varchar_size", True),
    ("create table a (v varchar(1024))", "ddl_check_varchar_size", False),
    ("create table a (v point)", "ddl_avoid_geometry", True),
    ("create table a (v int) engine=myisam", "ddl_check_table_db_engine", True),
    ("create table a (v int) engine = InnoDB", "ddl_check_table_db_engine", False),
    ("create table a (v int)", "ddl_check_table_db_engine", False),
    ("create table a (v int) default charset=latin1", "ddl_check_table_character_set", True),
    ("create table a (v int) character set utf8mb4", "ddl_check_table_character_set", False),
    ("create table a (v varchar(5) character set latin1) charset utf8mb4", "ddl_table_column_charset_same", True),
    ("create table a (v int) comment 'x'", "ddl_check_table_without_comment", False),
    ("create table a (v int comment 'x')", "ddl_check_table_without_comment", True),
    ("create table a (v int) partition by hash (v)", "ddl_check_table_partition", True),
    ("create table a (v int, foreign key (v) references b (w))", "ddl_disable_fk", True),
    ("create table a (v int references b (w))", "ddl_disable_fk", True),
    ("create table a (v int comment 'foreign key')", "ddl_disable_fk", False),
    ("create table a (v int auto_increment, w int auto_increment)", "ddl_check_auto_increment_field_num", True),
    ("create table a (v int, w int, key idx_v (v), key idx_vw (v, w))", "ddl_check_redundant_index", True),
    ("create table a (v int, w int, key idx_wv (w, v), key idx_v (v))", "ddl_check_redundant_index", False),
    ("create table a (`select` int)", "ddl_check_object_name_using_keyword", True),
    ("alter table a add column `group` int", "ddl_check_object_name_using_keyword", True),
    ("create table a (chosen int)", "ddl_check_object_name_using_keyword", False),
    ("create table " + "a" * 65 + " (v int)", "ddl_check_object_name_length", True),
    ("create table a (created datetime default now(), CREATE_TIME datetime default current_timestamp)", "ddl_check_create_time_column", False),
    ("create table a (created datetime default now())", "ddl_check_create_time_column", True),
    ("create table a (UPDATE_TIME datetime default now() on update now())", "ddl_check_update_time_column", False),
    ("create table a (UPDATE_TIME datetime default now())", "ddl_check_update_time_column", True),
    ("create table a (v varchar(5), fulltext key ft_v (v))", "ddl_avoid_full_text", True),
    ("create table a (v int, w int, x int, primary key (v, w, x))", "ddl_check_column_quantity_in_pk", True),
    ("create table a (v text, key idx_v (v(10)))", "ddl_check_index_column_with_blob", True),
]


def test_rules_on_texts(spark):
    """All cases at once; equal table names in many statements do not mix."""
    df = spark.createDataFrame([(n, sql) for n, (sql, _, _) in enumerate(CASES)], "id int, sql_text string")
    found = {(r.id, r.rule_name) for r in audit_definitions(df).select("id", "rule_name").collect()}
    wrong = [(sql, rule, broken) for n, (sql, rule, broken) in enumerate(CASES) if ((n, rule) in found) != broken]
    assert not wrong


@pytest.mark.parametrize("keys", [("schema_name", "table_name")])
def test_equal_names_in_two_schemas(spark, keys):
    columns = "schema_name string, table_name string, index_name string, seq long, column_name string, is_unique boolean, index_type string, constraint_type string"
    rows = [("one", "t", "idx_a", 1, "a", False, "BTREE", "INDEX"), ("two", "t", "idx_b", 1, "a", False, "BTREE", "INDEX"), ("two", "t", "idx_ab", 1, "a", False, "BTREE", "INDEX"),
            ("two", "t", "idx_ab", 2, "b", False, "BTREE", "INDEX")]
    indexes = spark.createDataFrame(rows, columns)
    found = catalog_rules.redundant_index(catalog_rules.indexes_with_columns(indexes, keys), keys).collect()
    assert [(r.schema_name, r.index_name, r.covered_by) for r in found] == [("two", "idx_b", "idx_ab")]
    assert {(r.schema_name, r.index_count) for r in catalog_rules.column_index_count(indexes, 0, keys).filter("column_name = 'a'").collect()} == {("one", 1), ("two", 2)}
    tables = spark.createDataFrame([("one", "t", "utf8mb4"), ("two", "t", "latin1")], "schema_name string, table_name string, charset string")
    cols = spark.createDataFrame([("one", "t", "a", "latin1"), ("two", "t", "a", "latin1")], "schema_name string, table_name string, column_name string, charset string")
    assert [r.schema_name for r in catalog_rules.charset_mismatch(cols, tables, keys).collect()] == ["one"]


def test_long_tables_are_read_in_step_with_their_length(spark):
    """Columns carry their own literals only, and neither the definition list nor the key is read again for each of them."""
    cols = ", ".join(f"c{n} int default '{n}' comment 'x, ({n})'" for n in range(300))
    found = defined(spark, f"create table t ({cols}, primary key (c1, C7)) comment='all'", "create table u (a int (", "create table v")
    columns = D.defined_columns(found)
    rows = {(r.id, r.column_name): r for r in columns.collect()}
    assert len([k for k in rows if k[0] == 0]) == 300
    assert all((rows[0, f"c{n}"].default_value, rows[0, f"c{n}"].column_comment) == (str(n), f"x, ({n})") for n in range(300))
    assert [n for n in range(300) if rows[0, f"c{n}"].is_primary_key] == [1, 7]
    assert D.defined_tables(found).filter("id = 0").first().table_comment == "all"
    plan = columns._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate"):]
    carried = generate[: generate.index("\n")]
    above = plan[: plan.index("Generate")]
    assert "_strings" not in carried and "items" not in above and "_strings" not in above
