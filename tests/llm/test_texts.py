"""Quality rules, pseudonyms, repeated passages, packing, token files and BPE."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stmtwarden.llm import bpe, mixing, packing, pii, quality, repeats, token_files
from stmtwarden.llm.tokens import Encoder
from stmtwarden.session import fresh_dir
from tests.llm import brute

ODD = [None, "", " \n\t", "one", "ä" * 30_000, "word " * 30_000, "x\x00y\x1cz", "𝒜 中文 ok", "a b", "a b"]


# --- quality -----------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_counts():
    rnd = random.Random(2)
    texts = ["a b c d e f g h i a b c d e f g h", "x\nx\n \n \ny#*", *[" ".join(rnd.choice("abc") for _ in range(60)) + "\n#|\n#|" for _ in range(20)], *ODD[:4], *ODD[6:]]
    for t in texts:
        assert quality.counts(t)[:5] == plain_counts(t)


def test_quality_verdict_is_adaptive(spark, docs_of):
    rnd = random.Random(3)
    clean = [" ".join(f"word{rnd.randrange(10**4)}" for _ in range(60)) for _ in range(120)]
    junk = [" ".join(f"w%%#{rnd.randrange(10**4)}" for _ in range(60)) for _ in range(4)]
    code = [" ".join(f"w%%#{rnd.randrange(10**4)}" for _ in range(60)) for _ in range(120)]
    docs = docs_of(clean + junk, source="prose").unionByName(docs_of(code, ids=range(1000, 1120), source="code")).unionByName(docs_of(ODD, ids=range(2000, 2010), lang=None, source=None))
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert len(got) == 254
    assert all(got[i]["kept"] for i in range(120)) and not any(got[i]["kept"] for i in range(120, 124))
    assert all(got[i]["kept"] for i in range(1000, 1120))
    assert not any(got[i]["kept"] for i in range(2000, 2010)) and all(got[i]["base_failed"] for i in range(2000, 2004))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_fences_match_exact_quantiles(docs_of):
    """Sketches of small groups hold all values, so fences follow from exact quantiles; one source leans on nothing but itself."""
    docs = docs_of([" ".join(["x" * (3 + i % 5), *["#"] * (i % 5)] + [f"{'y' * (3 + i % 5)}{j}" for j in range(30)]) + "\nz" * (i % 7) for i in range(40)])
    rows = quality.measured(docs.select("lang", "source", "text"), "q").select("lang", "source", F.col("q").alias("m"))
    f = quality.fences(rows).first()
    found = [quality.counts(r["text"]) for r in docs.collect()]

    def at(values, q):
        return sorted(values)[max(int(np.ceil(q * 40)) - 1, 0)]

    lengths, symbols, lines = [c[1] / c[0] for c in found], [c[2] / c[0] for c in found], [c[3] / c[5] for c in found]
    assert f["high_word_length"] == pytest.approx(at(lengths, 0.9) + 2.5 * (at(lengths, 0.9) - at(lengths, 0.5)))
    assert f["low_word_length"] == pytest.approx(at(lengths, 0.1) - 2.5 * (at(lengths, 0.5) - at(lengths, 0.1)))
    assert f["high_symbols"] == pytest.approx(max(at(symbols, 0.9) + 2.5 * (at(symbols, 0.9) - at(symbols, 0.5)), 1 / at([c[0] for c in found], 0.5)))
    assert f["high_dup_lines"] == pytest.approx(max(at(lines, 0.9) + 2.5 * (at(lines, 0.9) - at(lines, 0.5)), 1 / at([c[5] for c in found], 0.5)))
    assert quality.quality_report(docs.limit(0)).count() == 0 and quality.quality_filter(docs.limit(0)).count() == 0


def test_all_fences_differ_by_source(docs_of):
    rnd = random.Random(4)

    def text(word, marks, again):
        lines = [" ".join("w" * rnd.randrange(2, word) + str(rnd.randrange(10**5)) for _ in range(10)) for _ in range(10)]
        ends = rnd.randrange(again + 1)
        return "\n".join(x + "\nend if" * (n < ends) for n, x in enumerate(lines)) + "#" * rnd.randrange(marks + 1)

    docs = docs_of([text(6, 1, 0) for _ in range(150)], source="prose").unionByName(docs_of([text(24, 60, 6) for _ in range(150)], ids=range(150, 300), source="code"))
    rows = quality.measured(docs.select("lang", "source", "text"), "q").select("lang", "source", F.col("q").alias("m"))
    prose, code = (quality.fences(rows).where(F.col("source") == s).first() for s in ("prose", "code"))
    assert all(code[f"high_{r}"] > 1.15 * prose[f"high_{r}"] for r in quality.RATIOS)
    kept = {r["doc_id"] for r in quality.quality_filter(docs).collect()}
    assert len(kept) >= 295
    # what code may hold, prose may not
    odd = docs_of([text(6, 0, 0) + "#" * 50], ids=[999], source="prose")
    assert 999 not in {r["doc_id"] for r in quality.quality_filter(docs.unionByName(odd)).collect()}


# --- pseudonyms ----------------------------------------------------------------

def pseudonyms(docs_of, texts):
    return [r["text"] for r in pii.pseudonymised(docs_of(texts), key="k").orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_formats_stay_and_equal_values_stay_linked(docs_of):
    values = ["4316 5226 7852 5456", "+1 (293) 555-9179", "152.143.123.131", "2021-02-28", "28/02/2021", "078-05-1120", "that.92@mail2.example.com"]
    texts = [f"one {v} two" for v in values] + [f"({values[2]}) {values[6]}, {values[2]}"]
    out = pseudonyms(docs_of, texts)
    found = [o.removeprefix("one ").removesuffix(" two") for o in out]
    import re

    shape = lambda s: re.sub(r"\d", "9", s)
    for old, new in list(zip(values, found, strict=False)):
        assert old != new
        if "@" not in old and old.count(".") != 3:
            assert shape(old) == shape(new)
    assert luhn(found[0]) % 10 == luhn(values[0]) % 10 == 0
    assert all(0 <= int(x) < 256 for x in found[2].split("."))
    year, month, day = map(int, found[3].split("-"))
    assert found[4] == f"{day:02d}/{month:02d}/{year:04d}"
    assert found[1].startswith("+1 (")
    assert out[-1] == f"({found[2]}) {found[6]}, {found[2]}"


def test_what_fails_its_check_stays(docs_of):
    texts = ["4316522678525457", "300.1.1.1", "2021-02-30", "000-12-3456", "1.2.3", "v1.2.3.4.5", "a@b", "12 345", None, "", "é" * 20_000 + "@" * 9]
    assert pseudonyms(docs_of, texts) == texts


def test_whole_secrets_are_replaced(docs_of):
    long = "".join(random.Random(5).choice("ghijkLMNOP_-.") for _ in range(600))
    values = [("token: ", long, ""), ('"api_key" = "', long[:300], '", x'), ("password=", "hunT", " b"), ("Passwd: '", "p@sS: w=rd", "' c"), ("password: ", "q@mail.example", "")]
    docs = docs_of([head + value + tail for head, value, tail in values])
    got = pii.pseudonymised(docs, counts="n").orderBy("doc_id").collect()
    for (head, value, tail), row in zip(values, got, strict=True):
        new = row["text"][len(head) : len(row["text"]) - len(tail)]
        assert row["text"] == head + new + tail and len(new) == len(value) and set(new) <= set("0123456789abcdef")
        assert row["n"]["secret"] == 1 and row["n"]["email"] == 0


def test_secrets_and_other_columns(docs_of):
    docs = docs_of(['x token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" y', "no"])
    out = pii.pseudonymised(docs, counts="n")
    assert out.columns == [*docs.columns, "n"]
    a, b = out.orderBy("doc_id").collect()
    assert "2321bac4" not in a["text"] and len(a["text"]) == len(docs.first()["text"]) and a["n"]["secret"] == 1
    assert b["text"] == "no" and b["found"] == "f" and pii.pseudonymised(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("a,b", [(7, 11), (898, 989901 % 97 + 2), (1, 5)])
def test_feistel_permutes(spark, a, b):
    pairs = spark.range(a * b).select(F.floor(F.col("id") / b).alias("l"), (F.col("id") % b).alias("r"))
    out = pairs.select(pii.feistel(F.col("l"), F.col("r"), a, b, "k", "t").alias("p")).select("p.l", "p.r").distinct()
    assert out.count() == a * b and out.where(f"l < 0 or l >= {a} or r < 0 or r >= {b}").isEmpty()


# --- repeated passages ---------------------------------------------------------

def passages():
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [letters(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [letters(rnd.randrange(300)) + rnd.choice(shared)[rnd.randrange(20) :] + letters(rnd.randrange(200)) for _ in range(60)]
    texts += [shared[5]] * 3 + [shared[5][100:400] + shared[4], "z" * 199, "z" * 450, "yx" * 300, *ODD[:4], *ODD[6:]]
    return texts


def test_repeated_passages(docs_of, monkeypatch):
    texts = passages()
    want = brute.repeated(list(enumerate(texts)), 200)
    docs = docs_of(texts).repartition(5)
    got = {r["doc_id"]: r for r in repeats.repeats(docs).collect()}
    assert len(got) == len(texts)
    for d, (n, removed, spans, kept) in want.items():
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, spans, kept)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == removed
    out = repeats.repeats(docs, text_out=True)
    assert out.columns == docs.columns
    back = {r["doc_id"]: r for r in out.collect()}
    assert all(back[d]["text"] == (None if texts[d] is None else want[d][3].decode("utf-8", "ignore")) and back[d]["kept"] == "k" for d in back)
    assert repeats.repeats(docs.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 120), st.integers(150, 420)), min_size=2, max_size=6), st.integers(150, 230))
def test_difference_cover_steps(parts, width):
    """The three steps over blocks of one text each, without Spark."""
    rnd = random.Random(0)
    pool = ["".join(rnd.choice("ab") for _ in range(600)) for _ in range(4)]
    texts = [f"{i}" * 3 + pool[p][a : a + n] for i, (p, a, n) in enumerate(parts)]
    states = [repeats.State(repeats.Block(t.encode(), np.array([len(t)], np.int64).tobytes()), width, 3) for t in texts]
    replies = [None] * len(texts)
    import pyarrow as pa

    for kind, step in (("first", "first"), ("second", "second"), ("third", "third")):
        emitted = [getattr(s, step)(*([] if step == "first" else [replies[i]])) for i, s in enumerate(states)]
        replies = [[] for _ in texts]
        for bucket in range(3):
            rows = [(i, x) for i, e in enumerate(emitted) for b, x in e if b == bucket]
            if rows:
                table = pa.table({"block": pa.array([i for i, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "names": pa.array([x for _, x in rows], pa.binary())})
                for r in repeats.answer(table, kind).to_pylist():
                    replies[r["block"]].append(r)
    want = brute.repeated(list(enumerate(texts)), width)
    for i, s in enumerate(states):
        assert int(s.covered(replies[i]).sum()) == want[i][1]


# --- ids -----------------------------------------------------------------------

def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from(" \n'st<|endoftext|>")), max_size=60))
def test_encoder_is_the_library(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert array("I", _cached(("enc", path), lambda: Encoder(path, words=50)).encode(text)).tolist() == _cached(("lib", path), lambda: library(path))(text)


_made = {}


def _cached(key, make):
    if key not in _made:
        _made[key] = make()
    return _made[key]


def tiktoken_codec():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(path, public_tokenizers.PATTERN, words=200)
    own.machine.max_states = 3000
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdeé ü\n中'", max_size=120), st.sampled_from(["a" * 700, "ab" * 300, " " * 200, "=" * 150, "\n" * 70])), st.integers(1, 5))
def test_transducer_is_the_library(text, portion):
    own, lib = _cached("tiktoken", tiktoken_codec)
    ids = array("I", b"".join(p[1] for p in own.pieces(text))).tolist()
    assert ids == lib.encode_ordinary(text)
    assert "".join(own.decode(ids, portion)) == text


def test_bpe_query_columns(docs_of):
    import public_tokenizers

    own, lib = _cached("tiktoken", tiktoken_codec)
    docs = docs_of(ODD)
    rows = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        ids = lib.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 40))
def test_coder_round_trip(ids, size):
    x = np.array(ids + ids[:50], np.int64)
    assert mixing.decode(mixing.encode(x, size), len(x), size).tolist() == x.tolist()


def test_coder_compresses_and_blocks_are_independent():
    x = np.tile(np.arange(50, 250), 60)
    blocks = mixing.encode(x)
    assert sum(map(len, blocks)) < len(x)
    assert blocks[1] == mixing.encode(x[4096:8192])[0]


def test_coder_shifts_three_times_an_id_at_most(monkeypatch):
    calls, shift = [], mixing.RangeCoder.shift
    monkeypatch.setattr(mixing.RangeCoder, "shift", lambda self: (calls.append(1), shift(self)))
    x = np.random.default_rng(1).integers(0, 65536, 4 * 500)
    blocks = mixing.encode(x, 500)
    assert len(calls) == 3 * 500
    assert mixing.decode(blocks, len(x), 500).tolist() == x.tolist() and len(calls) == 6 * 500


def test_coder_keeps_the_least_likely():
    """Sure guesses and heavy counts that turn out wrong leave the interval wide enough."""
    rng = np.random.default_rng(2)
    same, turns, likely = np.full(4096, 7), np.tile([3, 9], 2048), np.where(rng.random(4096) < 0.99, 0, 65535)
    odd = [np.where(rng.random(4096) < 0.004, rng.integers(0, 65536, 4096), x) for x in (same, turns, likely)]
    x = np.concatenate([same, turns, likely, *odd, rng.integers(0, 65536, 4096), rng.choice([0, 1, 0x1000, 0xFFFF], 4000)])
    assert (mixing.decode(mixing.encode(x), len(x)) == x).all()


def test_ids_share_counts_and_guesses_wait():
    """Ids that nothing foretells cost their entropy under shared counts; a guess is asked about once it has been right, so rarely here."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40_000, 1 << 16)[rng.zipf(1.3, 40_000).clip(max=1 << 16) - 1]
    counts, asked = mixing.Counts.of(x), []

    class Noted(mixing.Mixed):
        def code(self, coder, lanes, contexts, bit):
            asked.append(len(lanes))
            return super().code(coder, lanes, contexts, bit)

    assert counts.shares.sum() == 1 << mixing.TOTAL_BITS and (counts.shares > 0).all() and set(counts.ids) == set(x)
    blocks = mixing.encode(x, 1000, counts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "Mixed", Noted)
        assert (mixing.decode(blocks, len(x), 1000, counts) == x).all()
    p = np.bincount(x)[x] / len(x)
    assert sum(map(len, blocks)) * 8 < 1.1 * -np.log2(p).sum()
    assert sum(asked) < len(x)


def test_carries_run_through_full_words():
    coder = mixing.RangeCoder(2, ids=10)
    coder.flat[:4], coder.flat[coder.width :][:2] = [4, 0xFFFF, 0xFFFF, 8], [1, 2]
    coder.place += [3, 2]
    coder.low[:], coder.value[:] = 1 << 63, [1 << 63, 5]
    coder.range[:] = 1 << 40
    coder.shift()
    assert coder.flat[:4].tolist() == [5, 0, 0, 0] and coder.flat[coder.width :][:3].tolist() == [1, 2, 1 << 15]


def test_token_files(spark, docs_of, tokenizer):
    texts, ids = [*ODD, "last <|endoftext|> token"], [5, 3, None, 9, 8, 7, 6, 4, 2, 2, 1]
    path = fresh_dir(spark, "tokens")
    docs = docs_of(texts, ids).repartition(4)
    token_files.write_tokens(docs, tokenizer, path)
    got = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    want, at, lib = [], 0, library(tokenizer)
    for d, t in sorted(zip(ids, texts, strict=True), key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")):
        data = np.array([*lib(t), 2], "<u4").tobytes()
        want.append((d, at, len(data) // 4, zlib.crc32(data), data))
        at += len(data) // 4
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got] == want
    empty = fresh_dir(spark, "tokens")
    token_files.write_tokens(docs.limit(0), tokenizer, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_wide_ids_are_kept():
    ids = np.array([5, 70_000, 2**31, 65_535, 65_536] * 2000)
    (_, _, docs, back), = token_files.read_segments(token_files.segment(0, 0, [(1, len(ids))], ids) + b"\n")
    assert docs == [(1, len(ids))] and back.tolist() == ids.tolist()


def test_lists_of_a_segment_are_checked():
    ids = np.random.default_rng(4).integers(0, 65536, 5000)
    data = bytearray(token_files.segment(0, 0, [(1, 2000), (None, 3000)], ids) + b"\n")
    (_, _, docs, back), = token_files.read_segments(bytes(data))
    assert docs == [(1, 2000), (None, 3000)] and back.tolist() == ids.tolist()
    data[token_files.HEAD.size + 40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_segments(bytes(data)))


def test_encoder_cuts_at_added_tokens(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext", "a\x1fb"]
    assert [array("I", x).tolist() for x in Encoder(tokenizer).encode_many(texts)] == [library(tokenizer)(t) for t in texts]
    assert array("I", Encoder(tokenizer).encode(texts[0])).tolist() == [64, 220, 50256, 275]


def test_damage_is_found():
    data = bytearray(token_files.segment(0, 0, [(1, 3)], np.array([5, 6, 7])) + b"\n")
    assert [d for _, _, d, _ in token_files.read_segments(bytes(data))] == [[(1, 3)]]
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_segments(bytes(data)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_fill_is_closest(counts, room):
    used = packing.fill(dict(counts), room)
    assert all(0 < c <= counts[x] for x, c in used.items())
    sums = {0}
    for x, c in counts.items():
        sums = {s + x * i for s in sums for i in range(c + 1) if s + x * i <= room}
    assert sum(x * c for x, c in used.items()) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 2000), max_size=12))
def test_plan_uses_every_piece_once(counts):
    used = dict.fromkeys(counts, 0)
    for pattern, times in packing.plan(counts, 50):
        assert times > 0 and sum(x * c for x, c in pattern.items()) <= 50
        for x, c in pattern.items():
            used[x] += c * times
    assert used == counts


def test_packing(docs_of, tokenizer):
    lib = library(tokenizer)
    rnd = random.Random(8)
    texts = [*ODD, *["same text"] * 40, *[" ".join(rnd.choice(["alpha", "beta"]) for _ in range(rnd.randrange(400))) for _ in range(60)]]
    rows = packing.pack(docs_of(texts), tokenizer, capacity=64, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len(texts)
    for d, parts in by.items():
        parts.sort(key=lambda r: r["start"])
        want = np.array([*lib(texts[d]), 1], "<u4").tobytes()
        assert b"".join(bytes(p["ids"]) for p in parts) == want and all(p["doc_tokens"] == len(want) // 4 and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in parts)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total / 64 * 1.02 + 1
    assert packing.pack(docs_of([]), tokenizer).count() == 0
