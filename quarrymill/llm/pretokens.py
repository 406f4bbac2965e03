"""Encoding whole texts through memos of pre-tokens.

A BPE tokenizer splits a text into pre-tokens and encodes each alone.  That split
is one regular expression here, over Unicode's letter, number and space classes,
and every pre-token's ids come from a bounded memo that the tokenizers library
fills.  Long texts are cut into pieces at places where a pre-token always ends.
Special strings are cut out first, as the library does.  Only a piece with a code
point that Python's Unicode tables lack, which a newer library may class as a
letter, goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers

from quarrymill.llm.texts import TwoGenerations, worker_state

#: The white space of both splits, and the contractions that they keep together.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Pre-tokens remembered by one worker process, at most twice this many.
MEMO = 250_000
#: Characters of a piece; it is longer only where a text has no place to cut.
BLOCK = 1 << 18
#: Pre-tokens always end before a blank or line end after something else, and
#: between a full stop of East Asian scripts and a letter.
_CUT = re.compile("(?<=\\S)(?=[ \\n])|(?<=[\\u3002\\uff01\\uff1f])(?=[\\u4e00-\\u9fff\\u3041-\\u3096\\u30a1-\\u30fa\\uac00-\\ud7a3])")
_BEYOND = re.compile("[\\U00010000-\\U0010ffff]")


def _ranges(codes: Iterable[int]) -> str:
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def _class(kind: str, end: int) -> str:
    """The code points below ``end`` whose general category begins with ``kind``, as the inside of a character class."""
    return _ranges(c for c in range(end) if unicodedata.category(chr(c)).startswith(kind))


@cache
def _splitter(words: bool, end: int) -> re.Pattern[str]:
    """The split of the word BPE or of byte-level BPE, with the letters and numbers below ``end``."""
    letter, number = _class("L", end), _class("N", end)
    if words:
        return re.compile(f"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")
    return re.compile(f"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@cache
def _unknown() -> re.Pattern[str]:
    return re.compile(f"[{_class('Cn', 0x10000)}]")


def byte_characters() -> list[str]:
    """How byte-level BPE writes each byte: itself if it prints, else a character beyond U+00FF."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    beyond = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(beyond)) for b in range(256)]


class PretokenEncoder:
    """Ids of texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = self.library.normalizer is not None
        self.split = _splitter(self.words, 0x10000).findall
        self.special = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile(f"({'|'.join(map(re.escape, self.special))})")
        self.written, self.tokenize = byte_characters(), self.library.model.tokenize
        self.memo = TwoGenerations(self._bytes, memo)

    def _ids(self, pretoken: str) -> list[int]:
        """The BPE model's ids of one pre-token."""
        if pretoken.isascii() and pretoken.isprintable():  # only blanks are written otherwise
            written = pretoken.replace(" ", self.written[0x20])
        else:
            written = "".join(map(self.written.__getitem__, pretoken.encode()))
        return [t.id for t in self.tokenize(written)]

    def _bytes(self, pretoken: str) -> bytes:
        return array("I", self._ids(pretoken)).tobytes()

    def _whole(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids

    def _folded(self, piece: str) -> str:
        """The word BPE's normal form: composed and lower-cased, each character for itself."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return piece.lower()

    def _pretokens(self, piece: str) -> list[str] | None:
        """A piece's pre-tokens; None if it has a code point that only the library may know."""
        split = self.split
        if not piece.isascii():
            if _unknown().search(piece):
                return None
            kinds = {unicodedata.category(c) for c in set(_BEYOND.findall(piece))}
            if "Cn" in kinds:
                return None
            if any(k[0] in "LN" for k in kinds):
                split = _splitter(self.words, 0x110000).findall
        return split(self._folded(piece) if self.words else piece)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK:
            found = _CUT.search(text, at + BLOCK)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def blocks(self, text: str) -> Iterator[tuple[str, list[str] | None]]:
        """(piece, its pre-tokens) in order; a special string is a piece with no list, as are those that only the library can split."""
        parts = self._special.split(text) if any(s in text for s in self.special) else (text,)
        for k, part in enumerate(parts):
            if k % 2:
                yield part, None
            elif part:
                for piece in self._pieces(part):
                    yield piece, self._pretokens(piece)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text; null is empty."""
        parts = []
        for piece, tokens in self.blocks(text or ""):
            parts.append(np.array(self._whole(piece), "<u4").tobytes() if tokens is None else b"".join(map(self.memo.__getitem__, tokens)))
        return b"".join(parts)


class PretokenCounter(PretokenEncoder):
    """Token counts from two tiers: given lengths of frequent pre-tokens, then a memo."""

    def __init__(self, path: str, frequent: dict[str, int], memo: int = MEMO):
        super().__init__(path, memo)
        self.lengths = _Tiers(frequent, TwoGenerations(lambda t: len(self._ids(t)), memo))

    def count(self, text: str | None) -> int:
        return sum(len(self._whole(piece)) if tokens is None else sum(map(self.lengths.__getitem__, tokens)) for piece, tokens in self.blocks(text or ""))


class _Tiers(dict):
    def __init__(self, frequent: dict[str, int], rest: TwoGenerations):
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, token: str) -> int:
        return self.rest[token]


def encoder(path: str, memo: int = MEMO) -> PretokenEncoder:
    """This process's encoder of a vocabulary file."""
    return worker_state(("encoder", path, memo), lambda: PretokenEncoder(path, memo))


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
