"""Rules that relate a statement's columns to the catalogue (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.lint.rule import VIOLATIONS, Rule, both, broken, configure

# Types compared as text and as numbers.
TEXT_TYPES = ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "set")
NUMBER_TYPES = ("tinyint", "smallint", "mediumint", "int", "bigint", "decimal", "float", "double")

_TEXT = "data_type IN (" + ", ".join(f"'{t}'" for t in TEXT_TYPES) + ")"
_NUMBER = "data_type IN (" + ", ".join(f"'{t}'" for t in NUMBER_TYPES) + ")"
_CONDITION = "clause = 'where'"
_JOINED = "clause = 'join' AND literal_kind = 'column' AND other_type IS NOT NULL"
_NAMED_FUNCTION = "regexp_like(function, r'^[A-Z_]')"
_CONVERSION = f"{_CONDITION} AND (({_TEXT} AND literal_kind = 'number') OR ({_NUMBER} AND literal_kind = 'string'))"

# Tested on each column use.
ROW_RULES: list[Rule] = [
    *both("auto-increment column set by hand", "clause = 'insert' AND is_auto_increment", ("dml_not_allow_insert_autoincrement", "error")),
    *both("join columns of different types", f"{_JOINED} AND data_type <> other_type", ("dml_check_join_field_type", "warn")),
    *both("join columns of different character sets",
          f"{_JOINED} AND (COALESCE(charset, '') <> COALESCE(other_charset, '') OR COALESCE(collation_name, '') <> COALESCE(other_collation, ''))",
          ("dml_check_join_field_character_set_Collation", "error")),
    *both("join column without an index", "clause = 'join' AND literal_kind = 'column' AND data_type IS NOT NULL AND NOT indexed",
          ("dml_check_join_field_use_index", "error")),
    *both("function on a condition column", f"{_CONDITION} AND data_type IS NOT NULL AND {_NAMED_FUNCTION}", ("dml_check_where_exist_func", "notice"), (9, "notice")),
    *both("function or arithmetic in a condition", f"{_CONDITION} AND function IS NOT NULL", ("dml_not_recommend_func_in_where", "warn")),
    *both("arithmetic on a condition column", f"{_CONDITION} AND function IS NOT NULL AND NOT {_NAMED_FUNCTION}", None, (111, "notice")),
    *both("condition value of another type", _CONVERSION, ("dml_check_where_exist_implicit_conversion", "notice"), (112, "notice")),
    *both("function or arithmetic on an indexed column", f"{_CONDITION} AND function IS NOT NULL AND indexed",
          ("dml_check_math_computation_or_func_on_index", "error")),
    *both("alias equal to a table or column", "clause = 'alias' AND (lower(column_name) = lower(table_name) OR other_column IS NOT NULL)",
          ("dml_check_alias", "warn"), (79, "warn")),
    *both("primary key updated", "clause = 'set' AND is_primary_key", ("dml_not_recommend_update_pk", "error"), (134, "error")),
    *both("sorting on a long column", "clause IN ('order', 'group') AND column_width > {p}",
          ("dml_check_order_by_field_length", "error", "2000"), (97, "error", "100")),
    *both("condition or sort column without an index", "clause IN ('where', 'group', 'order') AND data_type IS NOT NULL AND NOT indexed", None, (110, "warn")),
    *both("condition column that leads no index", "clause IN ('where', 'join') AND data_type IS NOT NULL AND NOT leads_any", None, (218, "warn")),
]

# Tested on the uses of one column, of one table, and on the whole statement.
COLUMN_RULES: list[Rule] = [
    *both("first column of a composite index without equality", "leads_composite AND conditions > 0 AND (equalities = 0 OR with_or)",
          ("dml_must_match_left_most_prefix", "error")),
]
TABLE_RULES: list[Rule] = [
    *both("composite index used without its first column", "any_indexed AND NOT any_single AND NOT first_leads", ("dml_must_use_left_most_prefix", "error")),
    *both("table joined to itself", "uses > 1", ("dml_check_same_table_joined_multiple_times", "error")),
]
STATEMENT_RULES: list[Rule] = [
    *both("OR over columns of different tables", "with_or AND condition_tables > 1", None, (143, "warn")),
]
RULES = ROW_RULES + COLUMN_RULES + TABLE_RULES + STATEMENT_RULES


def enrich(columns: DataFrame, catalog: DataFrame, indexes: DataFrame) -> DataFrame:
    """Column uses with what the catalogue knows of the column and its partner.

    The catalogue side of each join has one row per column, so a table named
    by a third of all statements multiplies nothing.
    """
    c = F.col
    per_column = indexes.join(indexes.groupBy("table_name", "index_name").agg(F.max("seq").alias("_width")), ["table_name", "index_name"])
    lead = c("seq") == 1
    of_index = per_column.groupBy(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).agg(
        F.lit(True).alias("_ix"),
        F.bool_or(lead).alias("_lead"),
        F.bool_or(lead & (c("_width") == 1)).alias("_single"),
        F.bool_or(lead & (c("_width") > 1)).alias("_composite"),
    )
    known = catalog.select(
        F.lower("table_name").alias("_t"),
        F.lower("column_name").alias("_c"),
        "data_type",
        "column_width",
        "is_primary_key",
        "is_auto_increment",
        "charset",
        "collation_name",
    )
    known = known.join(of_index, ["_t", "_c"], "left").select(
        "*", *[F.coalesce(a, F.lit(False)).alias(b) for a, b in (("_ix", "indexed"), ("_lead", "leads_any"), ("_single", "leads_single"), ("_composite", "leads_composite"))]
    ).drop("_ix", "_lead", "_single", "_composite")
    other = known.select(
        c("_t").alias("_ot"), c("_c").alias("_oc"), c("data_type").alias("other_type"), c("charset").alias("other_charset"), c("collation_name").alias("other_collation")
    )
    rows = columns.withColumns(
        {"_t": F.lower("table_name"), "_c": F.lower("column_name"), "_ot": F.lower("other_table"), "_oc": F.lower("other_column")}
    )
    # most rows are no join conditions: keys that match nothing spread them instead of the one null key
    rows = rows.withColumn("_ot", F.coalesce("_ot", F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(9973)).cast("string"))))
    return rows.join(known, ["_t", "_c"], "left").join(other, ["_ot", "_oc"], "left").drop("_ot", "_oc", "_c")


def audit_columns(columns: DataFrame, catalog: DataFrame, indexes: DataFrame, settings=None) -> DataFrame:
    """L2: violations by statement, each rule once per statement.

    Column uses are read once and shuffled once, by statement. The uses of a
    column, of a table and of the whole statement are then rolled up one after
    the other inside the same partition, carrying the rules broken so far.
    """
    c = F.col
    where = c("clause") == "where"
    plain = where & c("function").isNull() & c("operator").isNotNull()
    known = where & c("data_type").isNotNull()
    # LIKE alone does not count as a use of an index column, under OR it does.
    counted = plain & (~c("operator").isin("LIKE", "NOT LIKE") | c("with_or"))
    no = lambda x: F.coalesce(x, F.lit(False))
    test = lambda rules: F.concat("_v", broken(configure(rules, settings)))
    gather = F.array_distinct(F.flatten(F.collect_list("_v"))).alias("_v")
    rows = enrich(columns, catalog, indexes).withColumn("_v", F.array().cast(VIOLATIONS)).withColumn("_v", test(ROW_RULES))
    per_column = (
        rows.repartition("id")
        .groupBy("id", "_t", "column_name")
        .agg(
            gather,
            no(F.bool_or(known & c("leads_composite"))).alias("leads_composite"),
            F.count_if(counted).alias("conditions"),
            F.count_if(counted & (c("operator") == "=")).alias("equalities"),
            no(F.bool_or(where & c("with_or"))).alias("with_or"),
            no(F.bool_or(where)).alias("_where"),
            no(F.bool_or(counted & c("indexed"))).alias("_indexed"),
            no(F.bool_or(counted & c("leads_single"))).alias("_single"),
            F.min(F.when(counted & c("position").isNotNull(), F.struct("position", no(c("leads_composite")).alias("leads")))).alias("_first"),
            F.count_if(c("clause") == "table").alias("uses"),
        )
        .withColumn("_v", test(COLUMN_RULES))
    )
    per_table = (
        per_column.groupBy("id", "_t")
        .agg(
            gather,
            F.bool_or("_indexed").alias("any_indexed"),
            F.bool_or("_single").alias("any_single"),
            no(F.min("_first")["leads"]).alias("first_leads"),
            F.sum("uses").alias("uses"),
            F.bool_or("_where").alias("_where"),
            F.bool_or("with_or").alias("with_or"),
        )
        .withColumn("_v", test(TABLE_RULES))
    )
    per_statement = (
        per_table.groupBy("id")
        .agg(gather, F.bool_or("with_or").alias("with_or"), F.count_if(c("_where") & c("_t").isNotNull()).alias("condition_tables"))
        .withColumn("_v", test(STATEMENT_RULES))
    )
    return per_statement.select("id", F.explode(F.array_distinct("_v")).alias("_x")).select(
        "id", "_x.rule_name", "_x.level", "_x.message", F.lit(False).alias("execution_failed")
    )
