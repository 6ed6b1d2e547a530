"""Token ids of whole texts, from a vocabulary file of the tokenizers library.

A byte-level vocabulary splits a text into pieces, such as a word with the space before it, and
merges bytes inside a piece only. Two steps make use of that, and both give the ids of the whole
text. A piece never has a space after its first character, unless blanks follow each other, so
a text is cut before every single space; the ids of those parts are remembered, since natural
text repeats them. A part that is not remembered is split into its pieces, whose ids are
remembered as well, and only for a new piece the library's model is asked.

Memos are bounded and belong to one Python worker. Texts in which a space stands between blanks
or ends a run of them, texts with the string of an added token, which the library gives that token's id, parts
with letters beyond Latin ones, and vocabularies of other kinds go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

from tokenizers import Tokenizer

#: parts and pieces that a Python worker remembers; a full memo starts anew
MEMO_PARTS, MEMO_PIECES = 200_000, 500_000
#: longer ones are not remembered
MEMO_LENGTH = 64

_SPACE_IN_BLANKS = re.compile(r"\s (?:\s|\Z)")
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
#: characters whose kinds are beyond doubt
_PLAIN = re.compile(f"[\t-\r !-~{_LATIN}]*\\Z")
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters as they are, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids of pieces, asked from the model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder(dict):
    """Ids of parts of texts as little-endian 32-bit integers. Keys are parts without their leading space."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        kinds = json.loads(self.library.to_str())
        splits = kinds["pre_tokenizer"] or {}
        self.in_parts = (
            kinds["model"]["type"] == "BPE" and not kinds["normalizer"] and not kinds["model"].get("dropout")
            and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        )
        self.pieces = _Pieces(self.library.model)
        self.added = [token["content"] for token in kinds["added_tokens"]]

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The one of this Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        if _PLAIN.match(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        return self.whole(text)

    def __missing__(self, part: str) -> bytes:
        ids = self.part(f" {part}")
        if len(part) <= MEMO_LENGTH:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of the text."""
        if not self.in_parts or any(token in text for token in self.added) or _SPACE_IN_BLANKS.search(text):
            return self.whole(text)
        first, *parts = text.split(" ")
        return self.part(first) + b"".join(map(self.__getitem__, parts))
