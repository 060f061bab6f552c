"""Token ids by a byte-level BPE file of the tokenizers library, for whole texts."""

from __future__ import annotations

import re
from array import array

#: Splits texts of Latin letters as the file's own pre-tokeniser does; texts with other characters or added tokens go to the library whole.
LATIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[\d²³¹¼½¾]+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
OTHER = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level files write for bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


LETTERS = _byte_letters()


class Known(dict):
    """Ids of words, encoded by the model when they are first asked for, or taken over from the ``older`` generation."""

    def __init__(self, tokenize, older: dict[str, bytes]):
        self.tokenize, self.older = tokenize, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(LETTERS))]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Words are encoded by the library's model once and remembered. Memory is
    bounded: when ``words`` of them are known they become the older generation,
    from which those that occur again are taken over.
    """

    def __init__(self, path: str, words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.known = words, Known(self.tokenizer.model.tokenize, {})
        # the library cuts texts at its added tokens before all else
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif OTHER.search(text) or any(a in text for a in self.added):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                if len(self.known) > self.words:
                    self.known.older = {}
                    self.known = Known(self.known.tokenize, dict(self.known))
                out.append(b"".join(map(self.known.__getitem__, LATIN.findall(text))))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
