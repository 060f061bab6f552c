"""Rules on tables, columns and indexes of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.words import RESERVED_WORDS
from stmtwarden.lint.rule import Rule, both, configure, violations

_BLOB = "data_type IN ('tinyblob', 'blob', 'mediumblob', 'longblob', 'tinytext', 'text', 'mediumtext', 'longtext')"
_TEXT = "data_type IN ('tinytext', 'text', 'mediumtext', 'longtext')"
_SPATIAL = "data_type IN ('geometry', 'point', 'linestring', 'polygon', 'multipoint', 'multilinestring', 'multipolygon', 'geometrycollection')"

COLUMN_RULES: list[Rule] = [
    *both("long CHAR", "data_type = 'char' AND column_width > {p}", ("ddl_check_column_char_length", "error", "20"), (18, "notice", "20")),
    *both("NOT NULL without a default", "NOT is_nullable AND default_value IS NULL AND NOT is_auto_increment",
          ("ddl_check_field_not_null_must_contain_default_value", "warn"), (34, "warn")),
    *both("column without a comment", "column_comment = ''", ("ddl_check_column_without_comment", "notice"), (27, "notice")),
    *both("column without a default", f"default_value IS NULL AND NOT is_auto_increment AND NOT {_BLOB}", ("ddl_check_column_without_default", "error")),
    *both("time column without a default", "data_type IN ('timestamp', 'datetime') AND default_value IS NULL",
          ("ddl_check_column_timestamp_without_default", "error")),
    *both("time column without a default", "data_type IN ('timestamp', 'datetime', 'date', 'time', 'year') AND default_value IS NULL", None, (25, "error")),
    *both("large type with NOT NULL", f"{_BLOB} AND NOT is_nullable", ("ddl_check_column_blob_with_not_null", "error"), (16, "error")),
    *both("large type with a default", f"{_BLOB} AND default_value IS NOT NULL", ("ddl_check_column_blob_default_is_not_null", "error")),
    *both("TIMESTAMP column", "data_type = 'timestamp'", ("ddl_disable_type_timestamp", "warn"), (68, "warn")),
    *both("floating-point column", "data_type IN ('float', 'double')", ("ddl_check_decimal_type_column", "notice"), (13, "notice")),
    *both("DECIMAL column", "data_type = 'decimal'", ("ddl_check_bigint_instead_of_decimal", "notice"), (12, "notice")),
    *both("ENUM column", "data_type = 'enum'", ("ddl_check_column_enum_notice", "notice")),
    *both("SET column", "data_type = 'set'", ("ddl_check_column_set_notice", "notice")),
    *both("ENUM or SET column", "data_type IN ('enum', 'set')", None, (19, "notice")),
    *both("BLOB or TEXT column", _BLOB, ("ddl_check_column_blob_notice", "notice"), (17, "notice")),
    *both("integer of unusual width", "(data_type = 'int' AND column_width <> 10) OR (data_type = 'bigint' AND column_width <> 20)",
          ("ddl_check_column_type_integer", "notice"), (26, "notice")),
    *both("long VARCHAR", "data_type = 'varchar' AND column_width > {p}", ("ddl_check_varchar_size", "error", "1024")),
    *both("nullable column", "is_nullable", ("ddl_check_column_not_null", "notice"), (21, "warn")),
    *both("spatial column", _SPATIAL, ("ddl_avoid_geometry", "error")),
    *both("character set unlike the table's", "charset IS NOT NULL AND charset <> table_charset", ("ddl_table_column_charset_same", "warn"), (75, "warn")),
    *both("collation unlike the table's", "collation_name IS NOT NULL AND collation_name <> table_collation", None, (15, "warn")),
    *both("indexed large column", f"in_index AND {_BLOB}", ("ddl_check_index_column_with_blob", "error")),
    *both("indexed column nullable or without a default", "in_index AND (is_nullable OR (default_value IS NULL AND NOT is_auto_increment))", None, (3, "notice")),
    *both("long VARCHAR in an index", "in_index AND data_type = 'varchar' AND column_width > {p}", None, (64, "warn", "767")),
    *both("column in too many indexes", "index_count > {p}", ("ddl_check_index_too_many", "warn", "2"), (43, "warn", "2")),
]

TABLE_RULES: list[Rule] = [
    *both("no primary key", "pk_columns = 0", ("ddl_check_pk_not_exist", "error"), (8, "error")),
    *both("primary key without auto-increment", "pk_columns > 0 AND pk_auto_increment = 0", ("ddl_check_pk_without_auto_increment", "error"), (52, "warn")),
    *both("primary key with auto-increment", "pk_auto_increment > 0", ("ddl_check_pk_prohibit_auto_increment", "warn"), (51, "warn")),
    *both("primary key not BIGINT UNSIGNED", "pk_columns > 0 AND pk_bigint_unsigned < pk_columns", ("ddl_check_pk_without_bigint_unsigned", "error"), (54, "error")),
    *both("too many columns in the primary key", "pk_columns > {p}", ("ddl_check_column_quantity_in_pk", "warn", "2"), (23, "warn", "2")),
    *both("no creation time column", "NOT array_contains(created_columns, upper('{p}'))", ("ddl_check_create_time_column", "warn", "CREATE_TIME"), (219, "warn", "create_time")),
    *both("no update time column", "NOT array_contains(updated_columns, upper('{p}'))", ("ddl_check_update_time_column", "warn", "UPDATE_TIME"), (33, "error", "UPDATE_TIME")),
    *both("too many columns", "column_count > {p}", ("ddl_check_column_quantity", "notice", "40"), (20, "notice", "40")),
    *both("more than one auto-increment column", "auto_increment_count > 1", ("ddl_check_auto_increment_field_num", "warn"), (7, "warn")),
    *both("table without a comment", "table_comment = ''", ("ddl_check_table_without_comment", "notice"), (60, "notice")),
    *both("other engine", "lower(engine) <> lower('{p}')", ("ddl_check_table_db_engine", "notice", "Innodb"), (57, "warn", "INNODB")),
    *both("other character set", "lower(charset) <> lower('{p}')", ("ddl_check_table_character_set", "notice", "utf8mb4"), (56, "error", "UTF8MB4")),
    *both("other collation", "lower(collation_name) <> lower('{p}')", ("ddl_check_collation_database", "notice", "utf8mb4_0900_ai_ci")),
    *both("partitioned table", "is_partitioned", ("ddl_check_table_partition", "notice"), (58, "notice")),
    *both("auto-increment does not start at 0", "auto_increment_start <> 0", ("ddl_check_auto_increment", "warn"), (4, "warn")),
    *both("foreign key", "has_foreign_key", ("ddl_disable_fk", "error"), (67, "warn")),
    *both("database name without its suffix", "NOT endswith(lower(schema_name), lower('{p}'))", ("ddl_check_database_suffix", "notice", "_DB"), (32, "notice", "_DB")),
    *both("TEXT columns next to others", "text_columns > 0 AND pk_columns > 0 AND column_count > text_columns + pk_columns", ("ddl_avoid_text", "notice")),
    *both("character columns too long together", "char_length_sum > {p}", ("ddl_check_char_length", "error", "2000")),
    *both("too many indexes", "index_total > {p}", ("ddl_check_index_count", "notice", "5")),
    *both("too many secondary indexes", "secondary_total > {p}", None, (37, "warn", "5")),
    *both("no index", "index_total = 0", None, (153, "warn")),
]

INDEX_RULES: list[Rule] = [
    *both("too many columns in a composite index", "width > {p}", ("ddl_check_composite_index_max", "notice", "3"), (5, "warn", "5")),
    *both("index without its prefix", "plain AND NOT startswith(lower(index_name), lower('{p}'))", ("ddl_check_index_prefix", "error", "idx_"), (40, "warn", "idx_")),
    *both("unique index without its prefix", "is_unique AND NOT is_primary AND NOT startswith(lower(index_name), lower('{p}'))",
          ("ddl_check_unique_index_prefix", "error", "uniq_"), (41, "warn", "uniq_")),
    *both("unique index not named after table and columns",
          "is_unique AND NOT is_primary AND lower(index_name) <> lower(concat('IDX_UK_', table_name, '_', array_join(cols, '_')))",
          ("ddl_check_unique_index", "error"), (63, "warn")),
    *both("primary key not named after its table", "is_primary AND lower(index_name) <> lower(concat('PK_', table_name))", ("ddl_check_pk_name", "notice")),
    *both("full-text index", "index_type = 'FULLTEXT'", ("ddl_avoid_full_text", "error")),
    *both("redundant index", "redundancy IS NOT NULL", ("ddl_check_redundant_index", "error"), (55, "error")),
]

NAME_RULES: list[Rule] = [
    *both("name too long", "length(object_name) > {p}", ("ddl_check_object_name_length", "error", "64"), (47, "warn", "64")),
    *both("name in mixed case", "regexp_like(object_name, r'[a-z]') AND regexp_like(object_name, r'[A-Z]')",
          ("ddl_check_object_name_is_upper_and_lower_letter_mixed", "notice"), (46, "notice")),
    *both("reserved word as a name", "is_reserved", ("ddl_check_object_name_using_keyword", "error"), (49, "error")),
    *both("name with other characters", "NOT regexp_like(object_name, r'^[A-Za-z][A-Za-z0-9_]*$')", ("ddl_check_object_name_using_cn", "error"), (48, "warn")),
]

CONSTRAINT_RULES: list[Rule] = [
    *both("constraint on a column without an index", "NOT in_index", ("ddl_check_indexes_exist_before_creat_constraints", "notice")),
]

RULES = COLUMN_RULES + TABLE_RULES + INDEX_RULES + NAME_RULES + CONSTRAINT_RULES

#: What tells tables apart. A catalogue of several servers or schemas passes all it needs, such as
#: ``("instance_id", "schema_name", "table_name")``; none of the keys may be null, and ``table_name`` is one of them.
TABLE = ("table_name",)


def indexes_with_columns(indexes: DataFrame, keys=TABLE) -> DataFrame:
    """One row per index with its columns in order (a server bounds their number)."""
    return indexes.groupBy(*keys, "index_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "column_name"))), lambda s: s["column_name"]).alias("cols"),
        F.count("*").alias("width"),
        F.bool_or("is_unique").alias("is_unique"),
        F.bool_or(F.col("constraint_type") == "PRIMARY KEY").alias("is_primary"),
        F.max("index_type").alias("index_type"),
    )


def redundant_index(lists: DataFrame, keys=TABLE) -> DataFrame:
    """Indexes equal to another (``repeat``) or a left prefix of one (``redundant``).

    ``lists``: table_name, index_name, cols. Indexes of a table sit in one
    array sorted by column string; each looks for its first extension there.
    Of equal indexes the one last by name stays.
    """
    entry = F.struct(F.array_join("cols", ",").alias("key"), "index_name", "cols")
    tables = lists.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    a, i = F.col("all"), F.col("i")
    same_later = lambda x, y: (y["key"] == x["key"]) & (y["index_name"] > x["index_name"])
    longer = lambda x, y: (F.size(y["cols"]) > F.size(x["cols"])) & (F.slice(y["cols"], F.lit(1), F.size(x["cols"])) == x["cols"])
    # Indexes that are neither repeats nor prefixes; one of them covers each of the others.
    kept = F.filter(a, lambda x: ~F.exists(a, lambda y: same_later(x, y) | longer(x, y)))
    twin = F.element_at(F.filter(a, lambda y: y["key"] == i["key"]), -1)["index_name"]
    cover = F.get(F.filter(F.col("kept"), lambda y: longer(i, y)), F.lit(0))["index_name"]
    marked = tables.withColumn("kept", kept).select(*keys, "all", "kept", F.explode("all").alias("i"))
    kind = F.when(F.exists(a, lambda y: same_later(i, y)), "repeat").when(cover.isNotNull(), "redundant")
    return marked.select(
        *keys, i["index_name"].alias("index_name"), kind.alias("redundancy"), F.when(kind == "repeat", twin).otherwise(cover).alias("covered_by")
    ).filter("redundancy IS NOT NULL")


def redundant_new_index(lists: DataFrame, new_names: DataFrame, keys=TABLE) -> DataFrame:
    """L13 for an ALTER: only pairs that touch one of the new indexes."""
    found = redundant_index(lists, keys)
    new = new_names.select(*keys, "index_name").withColumn("_new", F.lit(True))
    source = new.select(*keys, F.col("index_name").alias("covered_by"), F.col("_new").alias("_new_source"))
    joined = found.join(new, [*keys, "index_name"], "left").join(source, [*keys, "covered_by"], "left")
    return joined.filter(F.coalesce("_new", F.lit(False)) | (F.coalesce("_new_source", F.lit(False)) & (F.col("redundancy") == "redundant"))).drop(
        "_new", "_new_source"
    )


def index_order_advice(indexes: DataFrame, selectivity: DataFrame, keys=TABLE) -> DataFrame:
    """Composite indexes whose columns do not fall in selectivity, with the order that does."""
    known = indexes.join(selectivity.select(*keys, "column_name", "selectivity"), [*keys, "column_name"], "left")
    per = known.groupBy(*keys, "index_name").agg(
        F.sort_array(F.collect_list(F.struct("seq", "column_name", "selectivity"))).alias("_s"),
        F.sort_array(F.collect_list(F.struct((-F.col("selectivity")).alias("rank"), "seq", "column_name"))).alias("_r"),
        F.bool_and(F.col("selectivity").isNotNull()).alias("_known"),
    )
    now = F.transform("_s", lambda s: s["column_name"])
    best = F.transform("_r", lambda s: s["column_name"])
    return per.filter(F.col("_known") & (F.size("_s") > 1)).select(*keys, "index_name", now.alias("cols"), best.alias("advised")).filter(
        F.col("cols") != F.col("advised")
    )


def column_index_count(indexes: DataFrame, limit: int = 2, keys=TABLE) -> DataFrame:
    """Columns used in more than ``limit`` indexes."""
    return indexes.groupBy(*keys, "column_name").agg(F.count_distinct("index_name").alias("index_count")).filter(F.col("index_count") > limit)


def charset_mismatch(columns: DataFrame, tables: DataFrame, keys=TABLE) -> DataFrame:
    """Columns whose character set is not their table's."""
    joined = columns.filter("charset IS NOT NULL").join(tables.select(*keys, F.col("charset").alias("table_charset")), [*keys])
    return joined.filter("charset <> table_charset").select(*keys, "column_name", "charset", "table_charset")


def trx_check(transactions: DataFrame, now: str, seconds: int) -> DataFrame:
    """Open transactions per table, and those open for longer than ``seconds``."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("wait_started").cast("timestamp"))
    return transactions.groupBy("database_name", "object_name").agg(
        F.count("*").alias("open_count"), F.count_if(age > seconds).alias("long_count"), F.max(age).alias("longest_seconds")
    )


def catalogue_columns(columns: DataFrame, tables: DataFrame, indexes: DataFrame, keys=TABLE) -> DataFrame:
    """Columns with the figures the column rules read."""
    uses = indexes.groupBy(*keys, "column_name").agg(F.count_distinct("index_name").alias("_uses"))
    of_table = tables.select(*keys, F.col("charset").alias("table_charset"), F.col("collation_name").alias("table_collation"))
    return (
        columns.join(uses, [*keys, "column_name"], "left")
        .join(of_table, [*keys], "left")
        .withColumns({"index_count": F.coalesce("_uses", F.lit(0)), "in_index": F.col("_uses").isNotNull()})
    )


def catalogue_tables(tables: DataFrame, columns: DataFrame, indexes: DataFrame, keys=TABLE) -> DataFrame:
    """Tables with the figures the table rules read."""
    c = F.col
    now = c("default_value") == "CURRENT_TIMESTAMP"
    renewed = F.contains(F.lower("extra"), F.lit("on update current_timestamp"))
    text = F.expr(_TEXT)
    per_column = columns.groupBy(*keys).agg(
        F.count("*").alias("column_count"),
        F.count_if("is_primary_key").alias("pk_columns"),
        F.count_if(c("is_primary_key") & c("is_auto_increment")).alias("pk_auto_increment"),
        F.count_if(c("is_primary_key") & (c("data_type") == "bigint") & c("is_unsigned")).alias("pk_bigint_unsigned"),
        F.count_if("is_auto_increment").alias("auto_increment_count"),
        F.count_if(text).alias("text_columns"),
        F.sum(F.when(c("data_type").isin("char", "varchar"), c("column_width")).otherwise(0)).alias("char_length_sum"),
        F.collect_set(F.when(now, F.upper("column_name"))).alias("created_columns"),
        F.collect_set(F.when(now & renewed, F.upper("column_name"))).alias("updated_columns"),
    )
    per_index = indexes.groupBy(*keys).agg(
        F.count_distinct("index_name").alias("_total"), F.count_distinct(F.when(c("constraint_type") != "PRIMARY KEY", c("index_name"))).alias("_secondary")
    )
    joined = tables.join(per_column, [*keys]).join(per_index, [*keys], "left")
    return joined.withColumns({"index_total": F.coalesce("_total", F.lit(0)), "secondary_total": F.coalesce("_secondary", F.lit(0))})


def object_names(tables: DataFrame, columns: DataFrame, indexes: DataFrame, reserved=RESERVED_WORDS, keys=TABLE) -> DataFrame:
    """Names of tables, columns and indexes, each once per table."""
    name = lambda df, kind, n: df.select(*keys, F.lit(kind).alias("object_type"), F.col(n).alias("object_name"))
    names = (
        name(tables, "table", "table_name")
        .unionByName(name(columns, "column", "column_name"))
        .unionByName(name(indexes.select(*keys, "index_name").distinct(), "index", "index_name"))
    )
    return names.withColumn("is_reserved", F.upper("object_name").isin(*reserved))


def audit_catalog(
    tables: DataFrame, columns: DataFrame, indexes: DataFrame, constraints: DataFrame | None = None, reserved=RESERVED_WORDS, settings=None, keys=TABLE
) -> DataFrame:
    """L3: (object_type, keys of the table, object_name, rule_name, level, message)."""
    lists = indexes_with_columns(indexes, keys)
    described = lists.join(redundant_index(lists, keys).select(*keys, "index_name", "redundancy"), [*keys, "index_name"], "left").withColumn(
        "plain", ~F.col("is_unique") & ~F.col("is_primary")
    )
    typed = lambda df, kind, n: df.withColumns({"object_type": F.lit(kind), "object_name": F.col(n)})
    jobs = [
        (typed(catalogue_columns(columns, tables, indexes, keys), "column", "column_name"), COLUMN_RULES),
        (typed(catalogue_tables(tables, columns, indexes, keys), "table", "table_name"), TABLE_RULES),
        (typed(described, "index", "index_name"), INDEX_RULES),
        (object_names(tables, columns, indexes, reserved, keys), NAME_RULES),
    ]
    if constraints is not None:
        held = indexes.select(*keys, "column_name").distinct().withColumn("_ix", F.lit(True))
        joined = constraints.join(held, [*keys, "column_name"], "left").withColumn("in_index", F.col("_ix").isNotNull())
        jobs.append((typed(joined, "constraint", "column_name"), CONSTRAINT_RULES))
    found = None
    for df, rules in jobs:
        chosen = configure(rules, settings)
        if chosen:
            part = violations(df, chosen, "object_type", *keys, "object_name")
            found = part if found is None else found.unionByName(part)
    return found

