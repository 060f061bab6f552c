"""The registered queries of this subpackage and the SQL for those that have some."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.llm import bpe, chat, chosen_path, forest, packing, pii, prefix_trie, quality, repeats, search, token_counts, token_files, warc
from stmtwarden.llm.common import table
from stmtwarden.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(build):
        QUERIES[key] = build
        if oracle:
            ORACLES[key] = oracle.strip()
        return build

    return wrap


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    module = importlib.import_module("public_tokenizers")
    return module.path(name)


@query("op1_near_dedup")
def op1(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query("op3_quality_rules")
def op3(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4(spark, sf_dir):
    out = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), counts="found")
    return out.select("doc_id", "text", *[F.col("found")[k].alias(f"n_{k}") for k in pii.KINDS])


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op7_repeated_passages")
def op7(spark, sf_dir):
    out = repeats.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + 8
    + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '#', '')))
    + (length(role) - length(replace(role, ':', '')))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op10_chat", OP10_SQL)
def op10(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.read_back(chat.formatted(chat.folded(chat.events_of(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), importlib.import_module("public_tokenizers").PATTERN)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""


@query("op8_warc", OP8_SQL)
def op8(spark, sf_dir):
    out = warc.deduplicated(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links,
  coalesce((SELECT min(b) FROM reach WHERE reach.a = v.vec_id), v.vec_id) AS component_id,
  v.vec_id = coalesce((SELECT min(b) FROM reach WHERE reach.a = v.vec_id), v.vec_id) AS kept
FROM v
"""


@query("op5_embedding_dedup", OP5_SQL)
def op5(spark, sf_dir):
    return forest.similar(table(spark, sf_dir, "embeddings"))


@query("op6_token_files")
def op6(spark, sf_dir):
    path = fresh_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), path, end_id=2)
    return token_files.read_tokens(spark, path)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS r FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS rep FROM i GROUP BY ALL),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s),
m AS (SELECT r, doc_id, 25 + (75 * len(t) * docs) // total AS m FROM d, s WHERE len(t) > 0),
scores AS (SELECT item_id, r, doc_id, CAST(sum(rep * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_counts")
def op13(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS own, c - c % 100 AS base,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM t GROUP BY c),
named AS (SELECT a.c, a.base, a.h, least(a.h, coalesce(b.own, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.base),
r AS (SELECT n.c, t.nth AS pos, role, text FROM named n JOIN t ON t.c = n.base AND t.nth < n.h
  UNION ALL SELECT n.c, t.nth - n.h + n.taken, role, text FROM named n JOIN t ON t.c = n.c AND t.nth >= n.h),
ways AS (SELECT c, pos + 1 AS depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY pos)) AS k FROM r
  UNION ALL SELECT c, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS ends FROM ways),
nodes AS (SELECT k, min(up) AS up, min(depth) AS depth, min(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY k),
born AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.k AS k, b.k AS u FROM ways a JOIN ways b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT below.k, sum(CASE WHEN born.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM below JOIN nodes x ON x.k = below.u LEFT JOIN born ON born.up = below.u GROUP BY below.k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(born.n, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN born ON born.up = n.k LEFT JOIN nodes p ON p.k = n.up
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
