"""Byte-level BPE as a lazily determinised transducer.

A sequence of tokens is the encoding of its bytes if each token encodes itself
and each neighbouring pair encodes to that pair. The nondeterministic machine
guesses where tokens end: a hypothesis is the last token, the bytes read since,
and the output it has not yet agreed on with the others. The deterministic one
has sets of hypotheses as states; a transition reads a byte, drops hypotheses
that no token continues, and emits what all that remain agree on. Tokens come
out after a bounded lookahead, as no hypothesis outlives the longest token.
States and transitions are made when first needed and forgotten all at once
when there are too many. Decoding streams through an incremental UTF-8 machine.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import map_arrow, small_batches
from stmtwarden.llm.tokens import LATIN, OTHER

#: The pattern for which LATIN is a faster equivalent on texts without OTHER characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The definition: the pair of lowest rank is joined, the leftmost of equals first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


NODE, LAST = (1 << 20) - 1, (1 << 18) - 1


class Transducer:
    """States and hypotheses are numbers, to keep some hundred thousand of them small.

    A hypothesis is (pending output << 38 | last token << 20 | trie node); a
    state is the packed list of its hypotheses.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = 300_000, pairs: int = 300_000):
        if len(ranks) >= LAST:
            raise ValueError(f"at most {LAST - 1} tokens")
        self.ranks, self.max_states, self.max_pairs = ranks, states, pairs
        self.tokens = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, inner = [-1], [True]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                inner[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    inner.append(False)
                node = to
            self.token_at[node] = rank
        if len(self.token_at) > NODE:
            raise ValueError(f"at most {NODE} distinct beginnings of tokens")
        self.inner = bytes(inner)
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.pending: list[tuple[int, ...]] = [()]
        self.pending_id: dict[tuple[int, ...], int] = {(): 0}
        start = array("Q", [LAST << 20]).tobytes()
        self.states, self.known = [start], {start: 0}
        #: state << 8 | byte -> next state, or (next state, what is emitted)
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}

    def follows(self, last: int, token: int) -> bool:
        own = self.own.get(token)
        if own is None:
            own = self.own[token] = merged(self.ranks, self.tokens[token]) == [token]
        if not own or last == LAST:
            return own
        key = last << 18 | token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.pairs[key] = merged(self.ranks, self.tokens[last] + self.tokens[token]) == [last, token]
        return ok

    def move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        out: list[tuple[tuple[int, ...], int]] = []
        for h in array("Q", self.states[state]):
            node = self.child.get((h & NODE) << 8 | byte)
            if node is None:
                continue
            pending, last, token = self.pending[h >> 38], h >> 20 & LAST, self.token_at[node]
            if token >= 0 and self.follows(last, token):
                out.append(((*pending, token), token << 20))
            if self.inner[node]:
                out.append((pending, last << 20 | node))
        first, agreed = out[0][0], 0
        least = min(len(p) for p, _ in out)
        while agreed < least and all(p[agreed] == first[agreed] for p, _ in out):
            agreed += 1
        packed = array("Q")
        for p, h in out:
            p = p[agreed:]
            i = self.pending_id.get(p)
            if i is None:
                i = self.pending_id[p] = len(self.pending)
                self.pending.append(p)
            packed.append(i << 38 | h)
        key = packed.tobytes()
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        found = (to, first[:agreed]) if agreed else to
        self.moves[state << 8 | byte] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if word in self.ranks:
            return [self.ranks[word]]
        if len(self.states) > self.max_states:
            self.reset()
        out, state, moves = [], 0, self.moves
        for byte in word:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            if type(found) is int:
                state = found
            else:
                state = found[0]
                out += found[1]
        if word:
            out += next(self.pending[h >> 38] for h in array("Q", self.states[state]) if not h & NODE)
        return out


class Utf8Stream:
    """An incremental UTF-8 machine: takes bytes in any portions, gives whole characters."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                cut -= back if need > back else 0
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encoding and decoding of texts; words are remembered up to a bound."""

    def __init__(self, path: str, pattern: str, words: int = 250_000):
        import regex

        self.ranks = read_ranks(path)
        self.machine, self.split, self.words = Transducer(self.ranks), regex.compile(pattern), words
        self.latin = pattern == PATTERN
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.table = [self.machine.tokens.get(i, b"") for i in range(max(self.machine.tokens, default=-1) + 1)]

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        """Per match its decimal ids, a comma after each, and its ids as 32-bit integers."""
        words = (self.split if not self.latin or OTHER.search(text) else LATIN).findall(text)
        if len(self.known) > self.words:
            self.known, self.older = {}, self.known
        known, older, encode = self.known, self.older, self.machine.encode
        for w in set(words).difference(known):
            found = older.get(w)
            if found is None:
                ids = encode(w.encode("utf-8", "surrogatepass"))
                found = ("".join([f"{i}," for i in ids]).encode(), array("I", ids).tobytes())
            known[w] = found
        return list(map(known.__getitem__, words))

    def decode(self, ids: Iterable[int], portion: int = 4096) -> Iterator[str]:
        stream, ids = Utf8Stream(), list(ids)
        for at in range(0, len(ids), portion):
            yield stream.feed(b"".join(map(self.table.__getitem__, ids[at : at + portion])))
        yield stream.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per file and Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian 32-bit) and the decoded text.

    Texts are encoded whole, each match of ``pattern`` separately, and decoded
    again from the ids. A null text is an empty one and has no ids. Columns of
    ``docs`` besides doc_id and text are not read.
    """
    small_batches(docs.sparkSession, 200)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, out = codec(path, pattern), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            said, ids, n = hashlib.sha256(), [], 0
            pieces = c.pieces(text or "")
            said.update(b"".join([p[0] for p in pieces])[:-1])
            ids = b"".join([p[1] for p in pieces])
            n = len(ids) // 4
            back, parts = hashlib.sha256(), []
            for part in c.decode(array("I", ids)):
                back.update(part.encode("utf-8"))
                if with_ids:
                    parts.append(part)
            out.append((doc_id, n, said.hexdigest(), back.hexdigest(), ids if with_ids else None, "".join(parts) if with_ids else None))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    return found if with_ids else found.drop("ids", "decoded")
