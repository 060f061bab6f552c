"""Block list, allow list and priority conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions import ipv4

# Order in which kinds of entries are tried.
ENDPOINT, TEXT, FINGERPRINT, INSTANCE, USER = range(5)


#: Characters of a gram. Patterns meet texts on one gram; shorter patterns are looked for in the row.
GRAM = 3
#: Texts from which it is estimated how rare a gram is; the estimate decides which gram is looked up, not what is found.
RARITY_ROWS = 2000
#: Entries up to which a list is sent to all tasks; longer ones meet the statements by a shuffle.
FEW_ENTRIES = 20_000


def _listed(entries: DataFrame, n: int) -> DataFrame:
    """A list's side of a join with statements, which are never the side that is sent to all tasks: cut into grams they outgrow their files many times over."""
    return F.broadcast(entries) if n <= FEW_ENTRIES else entries.hint("merge")


def _grams(text: Column, length: int = GRAM) -> Column:
    """Every run of ``length`` characters of a text, in one pass over it; none of a shorter text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _rarest_grams(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, pattern_id, piece): each pattern with that of its grams which the fewest of some texts hold."""
    cut = patterns.select("pattern", "pattern_id", F.explode(F.array_distinct(_grams(F.col("pattern")))).alias("piece"))
    some = texts.limit(RARITY_ROWS).select(F.explode(F.array_distinct(_grams(F.col("text")))).alias("piece"))
    counted = some.join(cut.select("piece").distinct(), "piece").groupBy("piece").agg(F.count("*").alias("n"))
    rare = F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")
    return cut.join(counted, "piece", "left").groupBy("pattern", "pattern_id").agg(rare)


def _contains_pairs(texts: DataFrame, patterns: DataFrame, lengths: list[int], n: int) -> DataFrame:
    """(key, pattern_id): the first pattern each text contains; ``lengths`` are those of the ``n`` patterns, ``GRAM`` for all from it on.

    A text that contains a pattern contains all its grams. The index holds each
    pattern's rarest gram, and texts meet it on their grams; pairs are
    verified. So a gram that stands in every text is met only for patterns that
    have no other. Patterns shorter than a gram stand in the index themselves.
    """
    pats = patterns.select("pattern_id", F.lower("pattern").alias("pattern")).groupBy("pattern").agg(F.min("pattern_id").alias("pattern_id"))
    texts = texts.select("key", F.lower("text").alias("text")).where("text IS NOT NULL")
    found = texts.select("key", F.lit(None).cast("long").alias("pattern_id")).limit(0)
    if 0 in lengths:
        # an empty pattern is in every text
        found = texts.select("key", pats.filter(F.length("pattern") == 0).agg(F.min("pattern_id")).scalar().alias("pattern_id"))
    if any(lengths):
        index = pats.where(F.length("pattern").between(1, GRAM - 1)).select("pattern", "pattern_id", F.col("pattern").alias("piece"))
        if GRAM in lengths:
            index = index.union(_rarest_grams(texts, pats.where(F.length("pattern") >= GRAM)))
        pieces = F.concat(*[_grams(F.col("text"), k) for k in lengths if k])
        met = texts.select("key", "text", F.explode(pieces).alias("piece")).join(_listed(index, n), "piece").where(F.contains(F.col("text"), F.col("pattern")))
        met = met.select("key", "pattern_id")
        found = found.unionByName(met) if 0 in lengths else met
    return found.groupBy("key").agg(F.min("pattern_id").alias("pattern_id"))


def _joined_matches(statements: DataFrame, blocklist: DataFrame) -> DataFrame:
    """(id, matched_id) by joins on keys."""
    blocklist = blocklist.filter("content IS NOT NULL")
    # a row for each kind, with at most GRAM + 2 numbers
    told = blocklist.groupBy("filter_type").agg(F.collect_set(F.least(F.length("content"), F.lit(GRAM))).alias("lengths"), F.count("*").alias("n")).collect()
    kinds = {r["filter_type"]: (sorted(r["lengths"]), r["n"]) for r in told}
    many = lambda k: kinds.get(k, ([], 0))
    kind = lambda k: blocklist.filter(F.col("filter_type") == k)
    ends = statements.select(F.col("id").alias("key"), F.posexplode("endpoints").alias("pos", "text"))
    hit = lambda df, rank, pos=F.lit(0), sub=F.lit(0): df.select(
        "key", F.struct(F.lit(rank).alias("rank"), pos.alias("pos"), sub.alias("sub"), F.col("pattern_id").alias("id")).alias("hit")
    )
    entry = lambda k, name: kind(k).select(F.col("id").alias("pattern_id"), F.col("content").alias(name))
    listed = lambda k, name: _listed(entry(k, name), many(k)[1])
    ips = ends.filter(ipv4.is_ip(F.col("text")))
    by_ip = ips.join(listed("ip", "text"), "text")
    nets = entry("cidr", "cidr").select("pattern_id", ipv4.network_bits(F.col("cidr")).alias("net")).filter("net IS NOT NULL")
    # Every address has 33 or 129 prefixes, so an address meets its networks on the prefix; equal addresses are cut once.
    bits = ips.select("text").distinct().withColumn("bits", ipv4.address_bits(F.col("text"))).filter("bits IS NOT NULL")
    prefixes = bits.select("text", F.explode(F.sequence(F.lit(2), F.length("bits"))).alias("n"), "bits").select("text", F.substr("bits", F.lit(1), F.col("n")).alias("net"))
    within = prefixes.join(_listed(nets, many("cidr")[1]), "net").groupBy("text").agg(F.min("pattern_id").alias("pattern_id"))
    by_net = ips.join(within.hint("merge"), "text")
    hosts = ends.filter(~ipv4.is_ip(F.col("text"))).select(F.struct("key", "pos").alias("key"), "text")
    by_host = _contains_pairs(hosts, entry("host", "pattern"), *many("host")).select(F.col("key.key").alias("key"), F.col("key.pos").alias("pos"), "pattern_id")
    texts = statements.select(F.col("id").alias("key"), F.col("sql_text").alias("text"))
    fps = statements.select(F.col("id").alias("key"), F.col("sql_fingerprint").alias("text"))
    found = [
        hit(by_ip, ENDPOINT, F.col("pos"), F.lit(0)),
        hit(by_net, ENDPOINT, F.col("pos"), F.lit(1)),
        hit(by_host, ENDPOINT, F.col("pos"), F.lit(0)),
        hit(_contains_pairs(texts, entry("sql", "pattern"), *many("sql")), TEXT),
        hit(_contains_pairs(fps, entry("fp_sql", "pattern"), *many("fp_sql")), FINGERPRINT),
        hit(statements.select(F.col("id").alias("key"), F.col("instance_id").alias("v")).join(listed("instance", "v"), "v"), INSTANCE),
        hit(
            statements.filter("db_user <> ''").select(F.col("id").alias("key"), F.col("db_user").alias("v")).join(listed("db_user", "v"), "v"),
            USER,
        ),
    ]
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    return union.groupBy("key").agg(F.min("hit")["id"].alias("matched_id")).withColumnRenamed("key", "id")


def blocklist_match(statements: DataFrame, blocklist: DataFrame) -> DataFrame:
    """statements with ``matched_id``, the entry that blocks each.

    ``statements``: id, endpoints (array), sql_text, sql_fingerprint,
    instance_id, db_user. ``blocklist``: id, filter_type, content. Lists of any
    length go the same way: they meet statements on keys. Entries without
    content, and networks that are none (see :func:`bad_entries`), match nothing.
    """
    return statements.join(_joined_matches(statements, blocklist).hint("merge"), "id", "left")


def bad_entries(blocklist: DataFrame) -> DataFrame:
    """Entries that can never match: no content, or a network that cannot be read."""
    broken = (F.col("filter_type") == "cidr") & ipv4.network_bits(F.col("content")).isNull()
    return blocklist.filter(F.col("content").isNull() | broken)


def blocklist_counters(matched: DataFrame, blocklist: DataFrame, time_column: str = "ts") -> DataFrame:
    """the list with rows matched in this batch added and the last time set."""
    batch = matched.filter("matched_id IS NOT NULL").groupBy("matched_id").agg(F.count("*").alias("_n"), F.max(time_column).alias("_t"))
    joined = blocklist.join(batch, blocklist["id"] == batch["matched_id"], "left")
    return joined.select(
        blocklist["id"],
        "filter_type",
        "content",
        (F.col("matched_count") + F.coalesce("_n", F.lit(0))).alias("matched_count"),
        F.coalesce("_t", "last_match_time").alias("last_match_time"),
    )


def blocklist_survivors(matched: DataFrame) -> DataFrame:
    """statements no entry blocks."""
    return matched.filter("matched_id IS NULL").drop("matched_id")


def allowlist_match(statements: DataFrame, allowlist: DataFrame) -> DataFrame:
    """statements with ``allowed_by``, the last entry equal to the statement.

    Entries compare as upper-cased text or as fingerprints (column
    ``fingerprint``). Each key keeps its last entry before the join, so the
    join never multiplies statements.
    """
    exact = (
        allowlist.filter("match_type <> 'fp_match'").groupBy(F.upper(F.trim("value")).alias("_text")).agg(F.max("id").alias("_exact"))
    )
    same_fp = allowlist.filter("match_type = 'fp_match'").groupBy(F.col("fingerprint").alias("sql_fingerprint")).agg(F.max("id").alias("_fp"))
    return (
        statements.withColumn("_text", F.upper(F.trim("sql_text")))
        .join(exact, "_text", "left")
        .join(same_fp, "sql_fingerprint", "left")
        .withColumn("allowed_by", F.greatest("_exact", "_fp"))
        .drop("_text", "_exact", "_fp")
    )


def allowlist_counters(matched: DataFrame, allowlist: DataFrame, time_column: str = "ts") -> DataFrame:
    """the allow list with this batch's matches added."""
    batch = matched.filter("allowed_by IS NOT NULL").groupBy("allowed_by").agg(F.count("*").alias("_n"), F.max(time_column).alias("_t"))
    return allowlist.join(batch, allowlist["id"] == batch["allowed_by"], "left").select(
        allowlist["id"],
        "match_type",
        "value",
        (F.col("matched_count") + F.coalesce("_n", F.lit(0))).alias("matched_count"),
        F.coalesce("_t", "last_matched_time").alias("last_matched_time"),
    )


# Levels from lowest to highest.
LEVELS = ("normal", "notice", "warn", "error")


def level_rank(level: Column) -> Column:
    """normal 0 < notice 1 < warn 2 < error 3; anything else -1."""
    expr = F.lit(-1)
    for rank, name in enumerate(LEVELS):
        expr = F.when(level == name, F.lit(rank)).otherwise(expr)
    return expr


def level_name(rank: Column) -> Column:
    expr = F.lit("")
    for n, name in enumerate(LEVELS):
        expr = F.when(rank == n, F.lit(name)).otherwise(expr)
    return expr


@dataclass(frozen=True)
class Condition:
    """``key operator value``; ``kind`` is int, float or string."""

    key: str
    operator: str
    value: str
    kind: str = "float"


# A statement graver than "warn" is of high priority unless configured otherwise.
DEFAULT_CONDITIONS = (Condition("audit_level", ">", "2", "int"),)

_COMPARE = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "CONTAINS": lambda a, b: a == b,
}
_TYPES = {"int": "bigint", "float": "double", "string": "string"}


def high_priority(records: DataFrame, conditions=DEFAULT_CONDITIONS) -> DataFrame:
    """``priority`` and ``reasons``; any condition met makes a record high.

    Conditions on columns the records do not have are skipped, and so are
    values that do not read as the condition's type.
    """
    reasons = []
    for c in conditions:
        if c.operator not in _COMPARE or (c.operator == "CONTAINS" and c.kind != "string"):
            continue
        if c.key == "audit_level":
            value = F.greatest(level_rank(F.col("audit_level")), F.lit(0))
        elif c.key in records.columns:
            value = F.col(c.key)
        else:
            continue
        typed = value.cast("string").try_cast(_TYPES[c.kind])
        met = _COMPARE[c.operator](typed, F.lit(c.value).try_cast(_TYPES[c.kind]))
        reasons.append(F.when(met, F.concat(F.lit(f"{c.key} {c.operator} {c.value}, is "), value.cast("string"))))
    listed = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return records.withColumn("reasons", listed).withColumn("priority", F.when(F.size("reasons") > 0, F.lit("high")).otherwise(F.lit("")))
