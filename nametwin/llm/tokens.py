"""Token ids of whole texts, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

# The characters that Unicode calls white space.
WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

# Where a text can be cut without changing its ids: after letters before white space or
# a stop, around white space, which a byte-level vocabulary parts so that the last space
# joins the word after it, and a word vocabulary drops.
PIECES = {
    "byte": f" ?[{LETTERS}]+(?![^{WHITE}.,])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]",
    "word": f"[{LETTERS}]+(?![^{WHITE}.,])|[^{WHITE}]+",
}
ENTRIES = 700_000  # words of a generation; about 250 MB a worker when full
LONGEST_KEPT = 48  # characters; longer pieces hardly ever come again


class _Uneven(Exception):
    """White space of more than one character lies at a cut."""


@cache
def _byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """Packed ids made when first asked for, in two generations of bounded size.

    When the young one is full it becomes the old one; what is asked for again moves
    back, so frequent pieces stay.
    """

    def __init__(self, owner: Encoder, entries: int):
        self.owner = owner
        self.entries = entries
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.make(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class _Pieces(_Kept):
    """Of pieces cut by `PIECES`."""

    def make(self, piece: str) -> bytes:
        own = self.owner
        if own.is_word(piece):
            word = piece.lower() if own.kind == "word" else piece
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_byte_characters())
            elif word[0] == " ":
                word = "\u0120" + word[1:]
            return own.pack([t.id for t in own.tokenize(word)])
        return own.pack(own.model.encode(piece, add_special_tokens=False).ids)


class _Words(_Kept):
    """Of what stands between two spaces, the first of them included."""

    def make(self, word: str) -> bytes:
        own = self.owner
        core = word.rstrip(".,")
        if own.is_word(core) and core[0] != " ":
            packed = own.pieces[own.lead + core]
            return packed + own.pieces[word[len(core) :]] if len(core) < len(word) else packed
        if own.lead and (not word or word[0] in WHITE or word[-1] in WHITE):
            raise _Uneven
        return own.join(own.lead + word)


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit numbers.

    Neither vocabulary merges across the cuts of `PIECES`, so the ids of a text are
    those of its pieces in order. Pieces repeat, so most cost a lookup; about twice
    `entries` words are remembered. Special tokens written out in a text part it and are
    the one id that the library gives them.
    """

    def __init__(self, path: str, kind: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.model = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        longest_first = sorted(self.special, key=lambda t: (-len(t), t))
        self.part = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split
        self.width = 2 if self.model.get_vocab_size() <= 65536 else 4
        self.code = "H" if self.width == 2 else "I"
        self.find = re.compile(PIECES[kind]).findall
        self.lead = " " if kind == "byte" else ""
        self.is_word = re.compile(f" ?[{LETTERS}]+").fullmatch
        self.tokenize = self.model.model.tokenize
        self.pieces = _Pieces(self, entries // 2)
        self.words = _Words(self, entries)

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def join(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(map(text.__contains__, self.special)):
            return self.plain(text)
        between = self.part(text)
        between[::2] = map(self.plain, between[::2])
        between[1::2] = [self.pack([self.special[t]]) for t in between[1::2]]
        return b"".join(between)

    def plain(self, text: str) -> bytes:
        """Of a text that holds no special token."""
        if not text:
            return b""
        first, *words = text.split(" ")
        if self.kind == "byte" and (not first or first[-1] in WHITE):
            return self.join(text)
        try:
            return self.join(first) + b"".join(map(self.words.__getitem__, words))
        except _Uneven:
            return self.join(text)


@cache
def encoder(path: str, kind: str, entries: int = ENTRIES) -> Encoder:
    """One encoder for all tasks of a worker, so that pieces stay known."""
    return Encoder(path, kind, entries)
