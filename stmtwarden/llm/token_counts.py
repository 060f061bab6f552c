"""Token counts by rank-synchronous merging of arrays.

Pre-tokens of a batch lie one after another in one flat array of symbols, each a
ragged row of it. In every round each row applies its pair of lowest rank, at all
places at once; rows without a pair that merges leave the arrays, and the symbols
they have left are counted. No row waits for another, so a batch needs as many
rounds as its slowest row.

A library that merges one place at a time, the leftmost first, may find a better
or equal pair next to a merge it has just made. Such a place is seen when the
merge is chosen, and the row's places to the right of it wait for the next round,
so that the result is the library's.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import map_arrow, small_batches, text_bytes

NONE = np.int32(np.iinfo(np.int32).max)
#: What the library writes for a space, as the model files do.
SPACE = "▁"


class Merges:
    """Merge table of a sentencepiece BPE model: symbols are characters and pieces, pairs have the rank of the piece they make."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [n for n in range(lib.vocab_size()) if not (lib.is_byte(n) or lib.is_control(n) or lib.is_unknown(n) or lib.is_unused(n))]
        score = {lib.id_to_piece(n): lib.get_score(n) for n in pieces}
        self.byte_fallback = any(lib.is_byte(n) for n in range(lib.vocab_size()))
        order = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        letters = sorted({c for p in score for c in p})
        names = {p: n for n, p in enumerate([*letters, *(p for p in score if len(p) > 1)])}
        pairs = {}
        for piece, s in score.items():
            for cut in range(1, len(piece)):
                a, b = names.get(piece[:cut]), names.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[s], names[piece])
        self.names, self.wide = names, len(names) + 1
        keys = np.array([a * self.wide + b for a, b in pairs], np.int64)
        sort = np.argsort(keys)
        self.keys, both = keys[sort], np.array([*pairs.values()], np.int32).reshape(-1, 2)[sort]
        self.ranks, self.made = both[:, 0].copy(), both[:, 1].copy()
        self.known = set(letters) & score.keys()
        # between a letter and a space no piece goes on, in the files seen; where one does, texts stay whole
        alone = "".join(c for c in "\t\n\r" if c not in set(letters))
        joined = any(SPACE in p.lstrip(SPACE) for p in score)
        self.words = re.compile(r"(?s).+" if joined else f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))

    def cost(self, char: str) -> int:
        """Tokens of a character that stays single."""
        return 1 if char in self.known or not self.byte_fallback else len(char.encode("utf-8", "surrogatepass"))

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of pairs of symbols; ``NONE`` where they do not merge."""
        key = a.astype(np.int64) * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)


def surviving(merges: Merges, words: list[str]) -> np.ndarray:
    """Number of tokens of each pre-token."""
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars, inverse = np.unique(code, return_inverse=True)
    text = [chr(c) for c in chars]
    if not merges.byte_fallback and any(c not in merges.known for c in text):
        raise ValueError("a model without bytes as pieces joins unknown characters; its counts are not built")
    sym = np.array([merges.names.get(c, -1) for c in text], np.int32)[inverse]
    row = np.repeat(np.arange(len(words)), lengths)
    # a character that no piece holds costs its bytes and never merges; the others are counted when their row is done
    extra = np.array([merges.cost(c) - 1 for c in text], np.int64)[inverse]
    out = np.bincount(row, extra, len(words)).astype(np.int64)
    rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        rank[:-1], made[:-1] = merges.look(sym[:-1], sym[1:])
        rank[:-1][row[1:] != row[:-1]] = NONE
    while len(sym):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        ended = least == NONE
        out[row[first[ended]]] += size[ended]
        if ended.any():
            stay = np.repeat(~ended, size)
            sym, row, rank, made = sym[stay], row[stay], rank[stay], made[stay]
            size, least = size[~ended], least[~ended]
            if not len(sym):
                break
        n = len(sym)
        least = np.repeat(least, size)
        hit = rank == least
        # of overlapping places every second one, counted from the left
        place = np.arange(n)
        begins = hit & ~np.append(False, hit[:-1])
        pick = hit & ((place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0)
        i = np.flatnonzero(pick)
        new = made[i]
        r, l = np.minimum(i + 2, n - 1), np.maximum(i - 1, 0)
        right = np.where((i + 2 < n) & (row[r] == row[i]), sym[r], -2)
        before = np.where((i > 0) & (row[l] == row[i]), sym[l], -2)
        joined = np.append(False, i[1:] - i[:-1] == 2) & (before != -2)
        before = np.where(joined, np.append(-2, new[:-1]), before)
        better = (merges.look(new, right)[0] <= least[i]) | (merges.look(before, new)[0] <= least[i])
        if better.any():
            # the row's places after the first such one wait
            same = np.append(False, row[i[1:]] == row[i[:-1]])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))
            seen = np.cumsum(better) - better
            keep = seen == seen[start]
            i, new = i[keep], new[keep]
        sym[i] = new
        gone = np.zeros(n, bool)
        gone[i + 1] = True
        fresh = np.zeros(n, bool)
        fresh[i] = True
        fresh[i[i > 0] - 1] = True
        # the left neighbour of a merge may itself be gone: then its own left one carries the pair
        fresh[i[i > 1] - 2] |= gone[i[i > 1] - 1]
        sym, row, rank, made, fresh = sym[~gone], row[~gone], rank[~gone], made[~gone], fresh[~gone]
        j = np.flatnonzero(fresh)
        nxt = np.minimum(j + 1, len(sym) - 1)
        rank[j], made[j] = merges.look(sym[j], sym[nxt])
        alone = (j + 1 >= len(sym)) | (row[nxt] != row[j])
        rank[j[alone]] = NONE
    return out


class Counter:
    """Counts tokens of texts; pre-tokens seen lately are remembered, at most twice ``words`` of them."""

    def __init__(self, path: str, words: int = 200_000):
        self.merges, self.words, self.known, self.older = Merges(path), words, {}, {}

    def learn(self, need: set[str], chunk: int = 1 << 20) -> None:
        if len(self.known) > self.words:
            self.known, self.older = {}, self.known
        new, size = [], 0
        for w in need.difference(self.known):
            n = self.older.get(w)
            if n is not None:
                self.known[w] = n
                continue
            new.append(w)
            size += len(w)
            if size >= chunk:
                self.known.update(zip(new, surviving(self.merges, new).tolist(), strict=True))
                new, size = [], 0
        if new:
            self.known.update(zip(new, surviving(self.merges, new).tolist(), strict=True))

    def count_many(self, texts: list[str | None], chunk: int = 500_000) -> list[int]:
        """Pre-tokens of many texts are learned together; a text of more than ``chunk`` of them is read in parts."""
        out, parts, held = [0] * len(texts), [], 0

        def settle() -> None:
            self.learn(set().union(*(p for _, p in parts)))
            for n, p in parts:
                out[n] += sum(map(self.known.__getitem__, p))
            parts.clear()

        for n, text in enumerate(texts):
            if not text:
                continue
            text = self.merges.library.normalize(text)
            if len(text) <= chunk:
                pieces = [self.merges.words.findall(text)]
            else:
                found = (m.group() for m in self.merges.words.finditer(text))
                pieces = iter(lambda found=found: list(islice(found, chunk)), [])
            for part in pieces:
                parts.append((n, part))
                held += len(part)
                if held >= chunk:
                    settle()
                    held = 0
        settle()
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per file and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model: str, *, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the sentencepiece library for whole texts, without
    begin or end; its normaliser is applied, and strings that look like special
    pieces are text. A null or empty text has no bytes and no tokens. Every row
    gives one row: null, repeated and tied doc_ids are documents like others.
    Columns besides doc_id and text are not read, whatever their names. An
    empty table gives no rows. Long texts are read in parts of half a million
    pre-tokens; models that join unknown characters are refused.
    """
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        tokens = np.array(counter(model).count_many(texts), np.int64)
        sizes = [len(text_bytes(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
