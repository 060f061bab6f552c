"""WARC archives, chat formatting, the registered queries and the pipeline."""

import hashlib

import pytest

import corpus_pipeline
from stmtwarden.llm import chat, warc
from stmtwarden.llm.queries import ORACLES, QUERIES
from stmtwarden.session import fresh_dir
from tests.compare import check, connect

SAID = r"\### Assistant: </turn> ok"


def test_archives(spark):
    big, other = "é" * 700, "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (None, "u", big), (2, "again", big), (10, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = fresh_dir(spark, "warc")
    got = warc.deduplicated(pages, path).collect()
    assert len(got) == len(rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None), (None, "response", None), (10, "response", None)}
    texts = {r[0]: r[2] or "" for r in rows}
    for r in got:
        data = texts[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    full = warc.resolved(warc.read_archives(spark, path)).collect()
    assert len(full) == len(rows) and all(r["payload"] == texts[r["page_id"]] for r in full)
    assert warc.deduplicated(pages.limit(0), fresh_dir(spark, "warc")).count() == 0


def test_damaged_payload_is_found():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 22\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.records_of(head + b"HTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"))


def test_events_fold_in_order(spark):
    rows = [
        (1, 10, 0, "start", "user", None), (1, 10, 1, "delta", None, "he"), (1, 10, 2, "delta", None, "llo"), (1, 11, 3, "start", "assistant", "bad "), (1, 11, 4, "delta", None, "answer"),
        (1, 11, 5, "regenerate", None, None), (1, 11, 6, "delta", None, "good"), (1, 10, 7, "edit", None, "hi"), (1, 12, 8, "start", "user", "gone"), (1, 12, 9, "delete", None, None), (2, 10, 1, None, "user", "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, msg_id long, seq long, kind string, role string, text string").repartition(4)
    got = {(r["conv_id"], r["msg_id"]): (r["seq"], r["role"], r["text"]) for r in chat.folded(events).collect()}
    assert got == {(1, 10): (0, "user", "hi"), (1, 11): (3, "assistant", "good"), (2, 10): (1, "user", "x")}
    assert chat.folded(events.limit(0)).count() == 0


def test_formatting_reads_back(spark):
    odd = [SAID, "", None, "\\", "\\l<#", "### user: x</turn>\n", "a\nb: c", "é𝒜" * 50, "\\b\\h", "x" * 100_000]
    rows = [(i, t, role, x) for i, x in enumerate(odd) for t, role in ((0, "user"), (1, "assistant"), (2, None), (3, "we:ird#<\\"), (3, "assistant"), (3, "assistant"))] + [(None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.read_back(chat.formatted(chat.folded(chat.events_of(df)))).collect()
    assert len(out) == len(odd) + 1
    plan = chat.read_back(chat.formatted(chat.folded(chat.events_of(df))))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
    for r in out:
        text = "n" if r["conv_id"] is None else odd[r["conv_id"]] or ""
        roles = ["assistant"] if r["conv_id"] is None else ["user", "assistant", "", "assistant", "assistant", "we:ird#<\\"]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x, text) for x in roles]
        assert r["loss"] == text * roles.count("assistant")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, key):
    assert check(spark, connect(sf_dir), QUERIES[key], ORACLES[key], sf_dir) is None


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_one_query(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == counts[5] and whole.select("doc_id").distinct().count() == counts[4]


def test_dedup_stage_keeps_one_of_equal_rows(spark, docs_of, sf_dir):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = docs_of([a, a, a, b, b, None, None, ""], ids=[3, 3, 5, None, None, 8, 8, 9])
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == [(-1, b), (3, a), (8, ""), (9, "")]


def test_dedup_stage_judges_rows_without_an_own_id(spark, docs_of, sf_dir):
    """Near copies without ids, and under a shared id, are reduced to one row; what only shares an id stays."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, f"end{n}"]) for n in range(4)]
    alone, far = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    kept = lambda texts, ids: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs_of(texts, ids=ids), sf_dir).collect())
    out = kept([near[0], near[1], near[2], alone], [None, None, None, None])
    assert len(out) == 2 and out[0] == (-1, alone) and out[1][1] in near
    # one of the rows under id 7 is a copy of document 3, the other is not
    assert kept([near[0], near[1], alone, far], [3, 7, 7, 9]) == [(3, near[0]), (7, alone), (9, far)]
    assert kept([near[0], near[1], near[2]], [None, 5, 4]) == [(4, near[2])]
    assert kept([near[0], near[0], near[1]], [6, 6, 8]) == [(6, near[0])]
    assert kept([], []) == []


ODD_TEXTS = [None, "", "x", "long " * 30_000, "same words here", "same words here"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs_of, sf_dir, name, stage):
    docs = docs_of(ODD_TEXTS, ids=[1, 2, 3, None, 5, 5])
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, None, 5} and sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    else:
        assert out.columns == docs.columns
        assert len(rows) == {"quality rules": 0, "near duplicates": 5}.get(name, 6)
        assert all(r["found"] == "f" and r["text_"] == "x" for r in rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_payloads_are_not_shuffled(spark):
    """Without broadcasts the join of the verdicts exchanges and sorts headers only; payloads lie in buckets."""
    rows = [(i, f"u{i}", "x" * 2000 + str(i % 5)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = warc.with_revisits(pages)
        assert {(r["page_id"], r["refers_to"]) for r in out.collect()} == {(i, None if i >= 35 else 35 + i % 5) for i in range(40)}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        join = plan[plan.index("SortMergeJoin") :]
        assert join.count("Exchange") == 1 and "page_id" in join
        assert "Bucketed: true" in join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
