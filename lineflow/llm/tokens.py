"""Token ids of whole texts, as the tokenizer gives them, with each distinct piece encoded once.

A text is cut where the tokenizer itself always cuts, whatever stands around: at single spaces
and line ends between visible characters, and between a letter and the comma or full stop that
ends a word. Pieces are looked up in a bounded table of a worker process. New ones that are
plain words, symbol runs or a word with a symbol run behind need no normalising and splitting
and go straight to the tokenizer's merges; all others are encoded like texts. Texts with
unusual white space are not cut at all. Tests compare the results with encodings of whole texts.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from codecs import charmap_decode
from collections.abc import Callable
from types import ModuleType
from typing import NamedTuple

from tokenizers import Tokenizer

#: Pieces a worker process remembers; beyond it a new table is begun, which takes over from the
#: last one what still occurs.
REMEMBERED = 250_000
#: Longer pieces, in code points, are not remembered.
LONG = 64

_BEFORE_STOP = re.compile(r"[.,](?<=[a-z\xdf-\xf6\xf8-\xff][.,])(?=[ \n]|$)")
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]"
_SYMBOLS = r"[!-&(-/:-@\[-`{-~]"
_SPACED = re.compile(rf"( ?{_LETTERS}+)?( ?{_SYMBOLS}+)?")
_BARE = re.compile(rf"({_LETTERS}+)?({_SYMBOLS}+)?")



def once_per_process(name: str, make: Callable[[], object]) -> object:
    """``make()``, called once in each process under this name. The package's functions travel
    to tasks by value, so their own globals would start anew with every task."""
    held = sys.modules.setdefault("_lineflow_held", ModuleType("_lineflow_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def forget_pieces() -> None:
    """Drop the pieces a worker remembers: for operators that encode nothing, in a worker that has
    encoded before."""
    held = sys.modules.get("_lineflow_held", ModuleType("")).__dict__
    for name in [name for name in held if name.startswith("ids ")]:
        del held[name]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer in a file, loaded once per process."""
    # Spark already runs one task per core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return once_per_process(f"tokenizer {path}", lambda: Tokenizer.from_file(path))


def _spaced_pieces(text: str) -> list[str]:
    plain = text.replace("\n", "").isprintable()  # no white space but spaces and line ends
    if not plain or text[:1] == " " or "  " in text or "\n " in text or " \n" in text:
        return [text]
    # NUL marks the cuts; a text that holds one is not plain.
    cut = _BEFORE_STOP.sub("\0\\g<0>", text).replace(" ", "\0 ")
    if "\n\n" not in text:
        cut = cut.replace("\n", "\0\n\0")
    return cut.split("\0")


def _bare_pieces(text: str) -> list[str]:
    return [p for p in _BEFORE_STOP.sub(" \\g<0>", text).replace("\n", " ").split(" ") if p]


class Cutting(NamedTuple):
    """How texts are cut into pieces, and which pieces are words and symbol runs."""

    name: str
    pieces: Callable[[str], list[str]]
    plain: re.Pattern
    lower: bool


#: For a byte-level tokenizer that keeps white space.
SPACED = Cutting("spaced", _spaced_pieces, _SPACED, False)
#: For a byte-level tokenizer that lower-cases and drops white space.
BARE = Cutting("bare", _bare_pieces, _BARE, True)


def _byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: visible ones for
    themselves, the others, in order, from code point 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_characters()
_ALL_BYTES = "".join(_BYTES[b] for b in range(256))


def _spelled(part: str) -> str:
    """A text as the characters of its UTF-8 bytes."""
    return charmap_decode(part.encode(), "strict", _ALL_BYTES)[0]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """The ids of pieces, each found when first asked for."""

    def __init__(self, model: Tokenizer, cutting: Cutting, older: dict[str, bytes]):
        self.model, self.merges, self.older = model, model.model.tokenize, older
        self.match, self.lower = cutting.plain.fullmatch, cutting.lower
        size = model.get_vocab_size()
        self.packed = once_per_process(f"packed ids {size}", lambda: [struct.pack("<I", i) for i in range(size)])

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            # A word of ASCII letters, as most new pieces are, needs no pattern to tell its parts.
            if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                spelled = (piece.lower() if self.lower else piece).replace(" ", _BYTES[32])
                packed = self.packed
                ids = b"".join([packed[token.id] for token in self.merges(spelled)])
            else:
                ids = self._found(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def _found(self, piece: str) -> bytes:
        plain = self.match(piece)
        if not plain:
            return _packed(self.model.encode_batch_fast([piece], add_special_tokens=False)[0].ids)
        packed, out = self.packed, []
        for part in plain.groups():
            if part:
                part = part.lower() if self.lower else part
                out += [packed[token.id] for token in self.merges(_spelled(part))]
        return b"".join(out)


def encoder(path: str, cutting: Cutting) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit integers."""
    model = tokenizer(path)
    held = once_per_process(f"ids {cutting.name} {path}", lambda: [Pieces(model, cutting, {})])

    def encode(texts: list[str]) -> list[bytes]:
        if len(held[0]) > REMEMBERED:
            held[0] = Pieces(model, cutting, dict(held[0]))
        ids = held[0].__getitem__
        return [b"".join(map(ids, cutting.pieces(text))) for text in texts]

    return encode
