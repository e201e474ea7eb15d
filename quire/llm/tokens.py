"""Exact encoding of texts with a public tokenizer, memoised by piece and by word.

The library spends most of its time on normalising and splitting. Its result for a text is
the concatenation of its results for the pieces between white space: the pre-tokenizer never
joins across white space, and the normalizers act within a piece. So each worker remembers
the ids of pieces, and below them those of words. A new piece made of ASCII and precomposed
Latin letters is lowered and split here (there, both steps are simple) and the library's
model merges only words not seen before; any other piece goes to the library whole. Texts
with a separator control (U+001C to U+001F), which Python and the library split differently,
go to the library whole, too.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Pieces that a worker remembers anew; when so many are, those before them are forgotten.
PIECES = 300_000
#: Longer pieces are encoded but not remembered.
LONGEST = 40
#: The id that ends each document.
END_ID = 1

_CONTROLS = re.compile("[\x1c-\x1f]").search
_SIMPLE = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+").fullmatch
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+").findall


#: The normalizers and the splitting rule that the shortcut was written for.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _as_written_for(settings: dict) -> bool:
    """Whether a tokenizer's own settings are those that the shortcut was written for."""
    before = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        (settings.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and [b.get("type") for b in before] == ["Split", "ByteLevel"]
        and before[0].get("pattern") == {"Regex": _RULE}
        and (before[0].get("behavior"), before[0].get("invert")) == ("Removed", True)
        and not before[1].get("add_prefix_space")
        and not before[1].get("use_regex")
        and settings["model"]["type"] == "BPE"
        and not settings["model"].get("dropout")
        and all(t["content"].startswith("<|") for t in settings.get("added_tokens") or [])
        and not any(settings.get(k) for k in ("truncation", "padding", "post_processor"))
    )


def word_bpe() -> str:
    """Place of the public word-level BPE vocabulary (a parameter wherever it is used)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Memory(dict):
    """Results of a function for what was met of late: a new generation, and the one before it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, without special tokens. Null and empty texts have none."""

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.four = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.pieces = Memory(self._piece, pieces)
        self.simple = _as_written_for(json.loads(self.tokenizer.to_str()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.merge(shown)])

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii() and piece.islower():  # most are plain words
            four = self.four
            return b"".join([four[t.id] for t in self.merge(piece)])
        if "<|" in piece or not (piece.isprintable() if piece.isascii() else _SIMPLE(piece)):
            return self._whole(piece)
        lowered = piece.lower()
        words = [lowered] if lowered.isalpha() and lowered.isascii() else _WORDS(lowered)
        # a word of a piece is by itself a piece with the same ids
        return self._word(piece) if words[0] == piece else b"".join([self.pieces[w] for w in words])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.simple or _CONTROLS(text):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))


@lru_cache(maxsize=1)
def encoder(path: str, pieces: int = PIECES) -> Encoder:
    """The encoder of this process; Spark reuses Python workers, so its memory serves many tasks. One is held at a time."""
    return Encoder(path, pieces)
