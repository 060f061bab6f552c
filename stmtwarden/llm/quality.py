"""Quality rules with adaptive thresholds.

Each document is measured once (a fixed base rule and a few ratios). Quantile
sketches of the ratios are built per language and source, merged to languages
and to the whole corpus, and give fences: documents far outside what is usual
for their language and source are rejected by a join with the fences. A small
group leans on its language, and a small language on the corpus, in proportion
to its size; there is no switch by size.

A fence is a tail quantile and a multiple of its distance to the median. Where
most documents have none of what is counted both are zero, and the smallest
share a document of median length can show (one in so many words or lines, from
a sketch of lengths) stands for them. A document's count is compared with what
the fence lets it expect, and chance (the root of that) is allowed for, so that
one symbol in a short text is not outside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stmtwarden.llm.common import Run, free_name, joined_small, saved, small_batches, text_bytes, window_hashes, word_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: ratio: (numerator, denominator, low fence too); those without a low fence are shares that are mostly zero
RATIOS = {"word_length": ("word_chars", "n_words", True), "symbols": ("n_symbols", "n_words", False), "dup_lines": ("n_dup_lines", "n_lines", False)}
LENGTHS = ["n_words", "n_lines"]
SKETCH_K = 4096
#: So many documents of the level above count towards a group's fences.
LEAN = 10
#: Usual is what lies between these quantiles; fences lie so many distances from the median to them further out.
LOW, HIGH, REACH = 0.1, 0.9, 2.5
#: A count may pass its fence by so many deviations of chance.
CHANCE = 3.0


def counts(text: str | None) -> tuple[int, ...]:
    b = text_bytes(text)
    words = b.split()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars = len(text or "") - (len(b) - len(b.translate(None, SPACE)))
    repeat = 0
    h = window_hashes(word_hashes(words), 8) if n > 8 else ()
    if len(h):
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            edge[at + 8] -= 1
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines)


def _counts(text: Column) -> Column:
    @arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)

    return run(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _ratio(m: Column, name: str) -> Column:
    num, den, _ = RATIOS[name]
    return F.when(m[den] > 0, m[num] / m[den]).otherwise(0.0)


def measured(docs: DataFrame, name: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(name, _counts(F.col("text").cast("string")))


def fences(rows: DataFrame) -> DataFrame:
    """Fences (lang, source, low_*, high_*) from rows (lang, source, m) that pass the base rule."""
    good = rows.where(~base_failed(F.col("m")))
    figures = {r: _ratio(F.col("m"), r) for r in RATIOS} | {d: F.col("m")[d].cast("double") for d in LENGTHS}
    sketches = good.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(n) for n, c in figures.items()])
    sketches = saved(sketches, "sketches")

    def quantiles(df: DataFrame, by: list[str], tag: str) -> DataFrame:
        merged = df.groupBy(*by).agg(F.sum("n").alias(f"n{tag}"), *[F.kll_merge_agg_double(n).alias(n) for n in figures])
        cols = [F.kll_sketch_get_quantile_double(n, F.lit(q)).alias(f"{n}_{p}{tag}") for n in figures for p, q in (("lo", LOW), ("mid", 0.5), ("hi", HIGH))]
        return merged.select(*by, f"n{tag}", *cols)

    one = quantiles(sketches, ["lang", "source"], "_s")
    lang = saved(quantiles(sketches, ["lang"], "_l"), "langs")
    whole = quantiles(sketches.withColumn("all", F.lit(0)), ["all"], "_a").first()
    out = joined_small(one, lang, ["lang"])

    def leaning(r: str, p: str) -> Column:
        up = (F.col(f"{r}_{p}_l") * F.col("n_l") + F.lit(whole[f"{r}_{p}_a"] if whole else None) * LEAN) / (F.col("n_l") + LEAN)
        return (F.col(f"{r}_{p}_s") * F.col("n_s") + up * LEAN) / (F.col("n_s") + LEAN)

    cols = []
    for r, (_, den, both) in RATIOS.items():
        lo, mid, hi = (leaning(r, p) for p in ("lo", "mid", "hi"))
        high = hi + REACH * (hi - mid)
        cols.append((high if both else F.greatest(high, 1 / leaning(den, "mid"))).alias(f"high_{r}"))
        if both:
            cols.append((lo - REACH * (mid - lo)).alias(f"low_{r}"))
    return saved(out.select("lang", "source", *cols), "fences")


def verdict(m: Column, limits: dict[str, str] | None = None) -> Column:
    """False if the base rule fails or a ratio lies outside the joined fences; a missing fence rejects nothing."""
    at = lambda c: F.col(limits[c] if limits else c)
    bad = F.lit(False)
    for r, (num, den, both) in RATIOS.items():
        if both:
            outside = (_ratio(m, r) > at(f"high_{r}")) | (_ratio(m, r) < at(f"low_{r}"))
        else:
            usual = at(f"high_{r}") * m[den]
            outside = m[num] > usual + CHANCE * F.sqrt(usual)
        bad = bad | F.coalesce(outside, F.lit(False))
    return ~base_failed(m) & ~bad


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept.

    Null and empty texts have no words and fail the base rule. Null languages
    and sources are groups of their own. Repeated rows count each. Columns of
    ``docs`` besides doc_id, text, lang and source are not read.
    """
    rows = measured(docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text")), "m").select("doc_id", "lang", "source", "m")
    with Run(docs.sparkSession) as run:
        rows = saved(rows, "measured")
        limits = fences(rows)
        run.keep(rows, limits)
    out = joined_small(rows, limits, ["lang", "source"])
    m = F.col("m")
    return out.select("doc_id", *[m[c].alias(c) for c in COUNTS[:-1]], base_failed(m).alias("base_failed"), verdict(m).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; rules as in :func:`quality_report`."""
    small_batches(docs.sparkSession)
    lang, source = F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")
    rows = docs.select(lang, source, _counts(F.col("text").cast("string")).alias("m"))
    with Run(docs.sparkSession) as run:
        limits = fences(saved(rows, "measured"))
        run.keep(limits)
    m, inner = free_name(docs, "m"), [free_name(docs, "key_lang"), free_name(docs, "key_source")]
    names = {c: free_name(docs, f"limit_{c}") for c in limits.columns[2:]}
    keyed = measured(docs.withColumns({inner[0]: lang, inner[1]: source}), m)
    limits = limits.select(F.col("lang").alias(inner[0]), F.col("source").alias(inner[1]), *[F.col(c).alias(n) for c, n in names.items()])
    out = joined_small(keyed, limits, inner)
    return out.where(verdict(F.col(m), names)).select(*[F.col(f"`{c}`") for c in docs.columns])
