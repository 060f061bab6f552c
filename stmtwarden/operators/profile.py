"""Table profiling (P).

All column figures come from one pass: the columns are turned into (column,
value) pairs, counted per value with map-side combining, and reduced per
column. A value that fills a third of the table leaves each task as one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^12 registers in the sketches of distinct values.
HLL_BITS = 12


def column_profile(df: DataFrame, columns: list[str], table_name: str = "") -> DataFrame:
    """Per column: rows, non-null rows, distinct values, largest group, widest value."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in columns])).alias("_p")
    ).select("_p.*")
    groups = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    # The value count per column is itself large, so it is reduced map-side again.
    return groups.groupBy(F.lit(table_name).alias("table_name"), "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"),
        F.count("value").alias("distinct_count"),
        F.max("n").alias("largest_group"),
        F.max(F.char_length("value")).alias("max_width"),
    )


def approx_profile(df: DataFrame, columns: list[str], table_name: str = "", error: float = 0.02) -> DataFrame:
    """P1 and P5 by sketches: one scan, one row per task, no per-value shuffle."""
    one = df.agg(F.count("*").alias("_rows"), *[F.approx_count_distinct(n, error).alias(n) for n in columns])
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col("_rows").alias("row_count"), F.col(n).alias("distinct_count")) for n in columns])).alias("_c")
    ).select(F.lit(table_name).alias("table_name"), "_c.*")


def profile_states(df: DataFrame, columns: list[str], period: Column, table_name: str = "", tracked: int = 1000) -> DataFrame:
    """Per period and column a state that merges: counts, widest value, an HLL and a heavy-hitter sketch.

    A task sends on one row per period, whatever its number of rows and
    values. A day's states are stored once; :func:`merged_profile` adds up any
    set of them.
    """
    state = lambda n: F.struct(
        F.count(n).alias("non_null_count"),
        F.max(F.char_length(F.col(n).cast("string"))).alias("max_width"),
        F.hll_sketch_agg(F.col(n).cast("string"), HLL_BITS).alias("values"),
        F.call_function("approx_top_k_accumulate", F.col(n).cast("string"), F.lit(tracked)).alias("heavy"),
    )
    per = df.groupBy(period.alias("_period")).agg(F.count("*").alias("_rows"), *[state(n).alias(f"_state{i}") for i, n in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"_state{i}").alias("state")) for i, n in enumerate(columns)])
    rows = per.select("_period", "_rows", F.explode(each).alias("_c"))
    return rows.select(F.lit(table_name).alias("table_name"), F.col("_period").alias("period"), "_c.column_name", F.col("_rows").alias("row_count"), "_c.state.*")


def merged_profile(states: DataFrame, tracked: int = 1000) -> DataFrame:
    """P1-P3, P5 from stored states: exact counts and widths, distinct values by sketch, skewness with its bounds.

    The share of the most frequent value lies between ``skewness_low`` and
    ``skewness_high``, which are 2 x 3.5 / size apart, the size being the power
    of two from 4 / 3 of ``tracked`` on (0.0034 at 1000). Distinct counts have
    a standard error of 1.04 / 64.
    """
    error = 3.5 / (1 << math.ceil(math.log2(tracked / 0.75)))
    per = states.groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null_count").alias("non_null_count"), F.max("max_width").alias("max_width"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_count"), F.call_function("approx_top_k_combine", "heavy", F.lit(tracked)).alias("_heavy"),
    )
    top = F.call_function("approx_top_k_estimate", "_heavy", F.lit(1))
    nulls = (F.col("row_count") - F.col("non_null_count")) / F.col("row_count")
    share = F.coalesce(F.try_element_at(top, F.lit(1))["count"], F.lit(0)) / F.col("row_count")
    low = F.greatest(share - error, nulls, F.lit(0.0)).alias("skewness_low")
    high = F.least(F.greatest(share + error, nulls), F.lit(1.0)).alias("skewness_high")
    return per.select("table_name", "column_name", "row_count", "non_null_count", "distinct_count", "max_width", low, high)


def column_selectivity(profile: DataFrame) -> DataFrame:
    """Distinct values per hundred rows; -1 for an empty table."""
    share = F.lit(100.0) * F.col("distinct_count") / F.nullif(F.col("row_count"), F.lit(0))
    return profile.select("table_name", "column_name", F.coalesce(share, F.lit(-1.0)).alias("selectivity"))


def column_skewness(profile: DataFrame) -> DataFrame:
    """Share of the most frequent value."""
    return profile.select("table_name", "column_name", (F.col("largest_group") / F.col("row_count")).alias("skewness"))


def column_discrimination(profile: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Share of rows without the most frequent value, and whether it is enough."""
    share = F.lit(1.0) - F.col("largest_group") / F.col("row_count")
    return profile.select("table_name", "column_name", share.alias("discrimination"), (share >= minimum).alias("is_enough"))


def index_selectivity(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """Statistics cardinality per hundred rows, by index."""
    per_index = indexes.groupBy("table_name", "index_name").agg(F.max("cardinality").alias("cardinality"))
    joined = per_index.join(tables.select("table_name", "table_rows"), "table_name")
    share = F.lit(100.0) * F.col("cardinality") / F.nullif(F.col("table_rows"), F.lit(0))
    return joined.select("table_name", "index_name", F.coalesce(share, F.lit(-1.0)).alias("selectivity"))


def column_cardinality(profile: DataFrame) -> DataFrame:
    """P5: number of distinct values."""
    return profile.select("table_name", "column_name", F.col("distinct_count").alias("cardinality"))


def max_column_width(profile: DataFrame, changes: DataFrame) -> DataFrame:
    """Column changes to a width below the widest stored value."""
    return changes.join(profile.select("table_name", "column_name", "max_width"), ["table_name", "column_name"]).filter(
        F.col("new_width") < F.col("max_width")
    )


def all_null_columns(profile: DataFrame) -> DataFrame:
    """Columns of a non-empty table without any value."""
    return profile.filter((F.col("row_count") > 0) & (F.col("non_null_count") == 0)).select("table_name", "column_name")


def table_rows(named: dict[str, DataFrame], limit_ten_thousands: int = 1000) -> DataFrame:
    """Row count of each table and whether it is over the limit."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in named.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.withColumn("too_large", F.col("row_count") > limit_ten_thousands * 10000)


def table_size(targets: DataFrame, tables: DataFrame, limit_mb: int = 1024) -> DataFrame:
    """Statements whose target table is over a size."""
    large = tables.filter(F.col("size_mb") > limit_mb).select("table_name", "size_mb")
    return targets.join(large, "table_name")


def affected_rows_by_plan(plan_rows: DataFrame) -> DataFrame:
    """P10: rows a statement would touch, as far as its plan decides it.

    ``affected_rows`` is the last step's estimate, ``total_rows`` the sum over
    all steps, ``full_scan`` tells of a step that reads a whole table. Whether
    the estimate will do or a count is worth its price is the caller's choice.
    """
    step = F.struct("select_id", "rows_est")
    per = plan_rows.groupBy("sql_id").agg(
        F.bool_or(F.col("access_type") == "ALL").alias("_full"), F.sum("rows_est").alias("_total"), F.max_by("rows_est", step).alias("_last")
    )
    return per.select("sql_id", F.col("_last").alias("affected_rows"), F.col("_total").alias("total_rows"), F.col("_full").alias("full_scan"))


def affected_rows_by_count(target: DataFrame, condition: str | None, limit: int | None = None) -> DataFrame:
    """P10: the count itself, for a condition in SQL and the statement's LIMIT."""
    rows = target if condition is None else target.filter(condition)
    return (rows.limit(limit) if limit is not None else rows).agg(F.count("*").alias("affected_rows"))


def affected_rows_shared(statements: Sequence[tuple[int, str, str | None, int | None]], tables: dict[str, DataFrame], per_scan: int = 200) -> DataFrame:
    """P10 for many statements at once: (id, table, condition in SQL, LIMIT), the last two may be None.

    Each table is read once for ``per_scan`` distinct conditions, all counted
    side by side in one aggregate; equal conditions are counted once, and a
    LIMIT cuts the count afterwards. Statements on other tables have no row.
    """
    parts = [next(iter(tables.values())).sparkSession.createDataFrame([], "id long, affected_rows long")]
    for name, df in tables.items():
        mine = [s for s in statements if s[1] == name]
        conditions = list(dict.fromkeys(s[2] for s in mine))
        for at in range(0, len(conditions), per_scan):
            block = {cond: f"_n{i}" for i, cond in enumerate(conditions[at : at + per_scan])}
            counts = df.agg(*[(F.count("*") if cond is None else F.count_if(F.expr(cond))).alias(n) for cond, n in block.items()])
            cut = lambda n, limit: F.col(n) if limit is None else F.least(n, F.lit(limit).cast("long"))
            rows = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), cut(block[cond], limit).alias("affected_rows")) for i, _, cond, limit in mine if cond in block])
            parts.append(counts.select(F.explode(rows).alias("_r")).select("_r.*"))
    return reduce(DataFrame.unionByName, parts)


def affected_rows_by_values(features: DataFrame) -> DataFrame:
    """P10: rows of an INSERT with a value list (input: text features)."""
    rows = F.regexp_count("values_list", F.lit("~"))
    return features.filter(F.col("kind").isin("INSERT", "REPLACE") & (rows > 0)).select("id", rows.cast("bigint").alias("affected_rows"))


def select_column_selectivity(columns: DataFrame, selectivity: DataFrame) -> DataFrame:
    """Selectivity above 0 of the columns each SELECT uses."""
    used = columns.filter(F.col("clause").isin("where", "select", "order", "group", "join") & F.col("column_name").isNotNull())
    used = used.select("id", "table_name", "column_name").distinct()
    return used.join(selectivity.filter("selectivity > 0"), ["table_name", "column_name"])


def table_meta(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns of a table with the index entries they are part of."""
    entries = indexes.select("table_name", "column_name", "index_name", "seq", "is_unique", "index_type", "cardinality")
    return columns.join(entries, ["table_name", "column_name"], "left")
