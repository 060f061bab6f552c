"""Ranked search, the prefix trie of conversations and token counts, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stmtwarden.llm import prefix_trie, search, token_counts
from stmtwarden.llm.queries import QUERIES
from tests.llm.test_texts import ODD

# --- token counts ----------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_counts_of_odd_texts(docs_of, model, library):
    rnd = random.Random(5)
    pieces = [library.id_to_piece(rnd.randrange(259, 32_000)).replace("▁", " ") for _ in range(2000)]
    texts = [*ODD, "<s> a </s> <unk> <0x0A>", "▁▁a▁", "\t\r\n", *[" " * n + "=" * n for n in range(40)], *["".join(rnd.choice(pieces) for _ in range(40)) for _ in range(200)]]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(texts), model, limit=30).collect()}
    want = [len(library.encode(t or "")) for t in texts]
    assert [got[n]["n_tokens"] for n in range(len(texts))] == want
    assert [got[n]["n_bytes"] for n in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[n]["over_limit"] for n in range(len(texts))] == [w > 30 for w in want]
    twice = token_counts.token_counts(docs_of(["a b", "a b", None], ids=[None, 4, 4]), model)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in twice.collect()) == [(-1, 2), (4, 0), (4, 2)]
    assert token_counts.token_counts(docs_of([]), model).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aabcehnorst  ▁\n.,=-é中𝒜", max_size=60), max_size=5))
def test_counts_equal_the_library(texts):
    import public_tokenizers

    counter = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.count_many(texts, chunk=3) == [len(x) for x in counter.merges.library.encode(texts)]


def test_merges_wait_for_better_pairs():
    """Where a merge opens a better pair to its right, the places after it wait, as they do when one place merges at a time."""
    merges = token_counts.Merges.__new__(token_counts.Merges)
    order = {"ab": 5, "aba": 1, "ba": 9, "abab": 0}
    names = {p: n for n, p in enumerate(["a", "b", *order])}
    pairs = {(names[p[:c]], names[p[c:]]): (order[p], names[p]) for p in order for c in range(1, len(p)) if p[:c] in names and p[c:] in names}
    merges.wide = len(names) + 1
    keys = sorted(a * merges.wide + b for a, b in pairs)
    both = [pairs[k // merges.wide, k % merges.wide] for k in keys]
    merges.keys, merges.ranks, merges.made = np.array(keys), np.array([r for r, _ in both], np.int32), np.array([m for _, m in both], np.int32)
    merges.names, merges.known, merges.byte_fallback = names, {"a", "b"}, True

    def plain(word):
        parts = list(word)
        while True:
            found = [(order[x + y], n) for n, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in order and (names[x], names[y]) in pairs]
            if not found:
                return len(parts)
            n = min(found)[1]
            parts[n : n + 2] = [parts[n] + parts[n + 1]]

    words = [f"{n:b}".replace("0", "a").replace("1", "b") for n in range(1, 600)]
    assert token_counts.surviving(merges, words).tolist() == [plain(w) for w in words]


def test_count_query(spark, library):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


# --- ranked search ----------------------------------------------------------------


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs, items, top=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total, df = len(found), sum(sum(c.values()) for _, c in found), Counter(t for _, c in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(plain_terms(text))
    out = set()
    for item, terms in asked.items():
        scores = []
        for doc_id, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(rep * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, rep in terms.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out |= {(item, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(scores)[:top])}
    return out


def searched(docs, items):
    return {tuple(r) for r in search.ranked(docs, items).collect()}


def test_search_of_odd_rows(spark, docs_of, monkeypatch):
    rnd = random.Random(7)
    words = ["Alpha", "beta", "gamma", "ÄÖ", "中文", "x1", "delta", "eps", "rare", "the"]
    texts = [*ODD, *["; ".join(rnd.choices(words, range(10, 0, -1), k=rnd.randrange(1, 25))) for _ in range(150)], *["alpha beta"] * 25, *["THE the the"] * 15]
    ids = [None, *range(1, len(texts))]
    ids[30:33] = [40, 40, None]
    docs = docs_of(texts, ids=ids)
    rows = [(1, "alpha, BETA beta"), (2, None), (3, ""), (4, "nowhere"), (None, "ÄÖ"), (None, "x1"), (6, "the rare 中文"), (6, "rare"), (7, " ".join(words * 3)), (8, "word " * 2000)]
    items = spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, tf long, term string")
    want = plain_search(list(zip(ids, texts, strict=True)), rows)
    assert searched(docs, items) == want and {r[0] for r in want} == {1, None, 6, 7, 8}
    assert len(searched(docs, items)) == search.ranked(docs, items).count()
    # items in several passes
    monkeypatch.setattr(search, "ITEM_TERMS", 2)
    assert searched(docs, items) == want
    assert searched(docs.limit(0), items) == set() and searched(docs, items.limit(0)) == set()
    assert searched(docs_of([None, "", "--"]), items) == set()


@pytest.mark.parametrize("deep", [400, 1])
def test_tree_bounds_lose_nothing(monkeypatch, deep):
    """Small leaves and deep trees find what scoring all documents finds."""
    monkeypatch.setattr(search, "LEAF_DOCS", 3)
    monkeypatch.setattr(search, "DEEP", deep)
    rnd = random.Random(11)
    words = [f"w{n}".encode() for n in range(30)]
    docs = [(n, [w for w in words for _ in range(rnd.choice([0, 0, 0, 1, 1, 4]))] or words[:1]) for n in range(400)] + [(1000 + n, words[:3]) for n in range(40)]
    df = Counter(int(w[1:]) for _, t in docs for w in set(t))
    total = sum(len(t) for _, t in docs)
    rows = [{"item_id": i, "term": w, "rep": c} for i in range(20) for w, c in Counter(rnd.choices(words, k=6)).items()]
    queries = search.Queries(rows, words, df, len(docs))
    best = [[] for _ in queries.ids]
    visited = []
    monkeypatch.setattr(search, "order_of", lambda d: visited.append(d) or (d is None, d or 0))
    for part in (docs[:200], docs[200:]):
        cut, rank, tf = [0], [], []
        for _, t in part:
            c = sorted((int(queries.rank[int(w[1:])]), k) for w, k in Counter(t).items())
            rank += [r for r, _ in c]
            tf += [k for _, k in c]
            cut.append(len(rank))
        m = search.norms(np.array([len(t) for _, t in part]), len(docs), total)
        tree = search.Tree(queries, [d for d, _ in part], m, np.array(cut), np.array(rank), np.array(tf))
        assert sorted(n for a, b in (tree.runs[x] for x in range(len(tree.runs)) if not tree.children[x]) for n in range(a, b)) == list(range(len(part)))
        search.search_tree(tree, queries, best, 10)
    got = {(queries.ids[n], k + 1, d, -s) for n, found in enumerate(best) for k, (s, (_, d)) in enumerate(found)}
    assert got == plain_search([(d, b" ".join(t).decode()) for d, t in docs], [(r["item_id"], " ".join([r["term"].decode()] * r["rep"])) for r in rows])
    assert len(visited) < 0.8 * len(docs) * 20


# --- prefix trie ----------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(r, key=lambda t: t[0])] for c, r in own.items()}
    full = {}
    for c, r in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + r[h:]
    members = {}
    for c, r in full.items():
        for d in range(len(r) + 1):
            members.setdefault(tuple(r[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {}
    for c in sorted(full):
        ends.setdefault(tuple(full[c]), []).append(str(c))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()) for p, m in members.items())


def trie(df, **more):
    rows = prefix_trie.prefix_trie(df, **more).collect()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows), key=lambda r: (r[:2], r[2:]))


COLUMNS = "conv_id long, turn long, role string, text string, comp int, depth string, conv long, k1 int"


@pytest.mark.parametrize(("small", "depths"), [(20_000, 1024), (1, 4), (7, 16)])
def test_trie_equals_plain_one(spark, monkeypatch, small, depths):
    monkeypatch.setattr(prefix_trie, "DEPTHS", depths)
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(200, 230), 305, 306, -7, -107, 1000, 1003]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "hä", "", None, "long " * 40])))
    rows += [(400, t, "user", f"step {t}") for t in range(120)] + [(None, 0, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(500, 540) for t in range(12)]
    df = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], COLUMNS).repartition(5)
    want = sorted(plain_trie(rows), key=lambda r: (r[:2], r[2:]))
    assert trie(df, small=small) == want
    assert any(r[1] == 0 for r in want)


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert trie(empty) == []
    alone = spark.createDataFrame([(None, 0, "user", "x", 1, "d", 2, 3)], COLUMNS)
    assert trie(alone) == []
    # the only turn is among the first h, and the conversation to start from is absent
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert trie(spark.createDataFrame([(c, 0, "user", "x", 1, "d", 2, 3)], COLUMNS)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # repeated rows are turns like others
    rows = [(0, 1, "user", "x")] * 3 + [(0, 2, "user", "y" * 100_000)]
    assert trie(spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], COLUMNS)) == plain_trie(rows)


def test_decomposition_of_shapes():
    rnd = random.Random(1)
    for shape in ("chain", "star", "random"):
        for n in (1, 2, 3, 50, 3000):
            parent = [0, *({"chain": v - 1, "star": 0, "random": rnd.randrange(v)}[shape] for v in range(1, n))]
            own = [rnd.randrange(5) for _ in range(n)]
            weight, want = [1 + rnd.randrange(3) for _ in range(n)], list(own)
            for v in range(n - 1, 0, -1):
                want[parent[v]] += want[v]
                weight[parent[v]] += weight[v]
            assert prefix_trie.decompose(parent, weight, [own]) == [want]
