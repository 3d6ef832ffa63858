"""Tokenisation inside tasks: the tokenizers library, called once for each distinct piece of text.

A text is cut at spaces where no token can cross, a stretch between two cuts into the pieces that the vocabulary's own
pattern cuts there, and each distinct piece is encoded once by the library's model and remembered. Stretches that hold
anything but plain letters, digits and signs take the library's whole way. The ids are those of encoding the whole
text at once (tests hold the two against each other).
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import islice


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others for
    the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


def _class(chosen: Callable[[str], bool], *ranges: range) -> str:
    return "".join(re.escape(chr(c)) for r in ranges for c in r if chosen(chr(c)))


#: Letters below U+0250, those of them that neither lower-casing nor composition changes, and signs; the apostrophe is
#: left out, for contractions are cut in ways of their own.
LETTERS = _class(str.isalpha, range(0x250))
STABLE = _class(lambda c: c.isalpha() and c == c.lower() and unicodedata.is_normalized("NFC", c), range(0x250))
SIGNS = _class(lambda c: unicodedata.category(c)[0] in "PS" and c != "'" and unicodedata.is_normalized("NFC", c), range(0x250), range(0x2010, 0x2028), range(0x2030, 0x205F))


class Known(dict):
    """Ids by text, learnt when first asked for. Long texts are not remembered; at ``most`` entries the younger half is
    forgotten, since frequent texts come early."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        self.learn, self.most = learn, most

    def __missing__(self, s: str) -> bytes:
        ids = self.learn(s)
        if len(s) <= 64:
            if len(self) >= self.most:
                self.trim(self.most // 2)
            self[s] = ids
        return ids

    def trim(self, left: int) -> None:
        """Keep the oldest entries, at most ``left``."""
        for young in list(islice(reversed(self), max(0, len(self) - left))):
            del self[young]


class Encoder:
    """``encode_all(texts)`` gives each text's ids as bytes, little-endian, two bytes each (ids stay under 65,536).

    special_as_text: the strings of special tokens are ordinary text; else they have their own ids, as the library
    reads them by default.
    """

    letters = _byte_letters()
    plain: re.Pattern  # the vocabulary's pattern on plain characters
    remembered = 200_000  # texts at most

    def __init__(self, path: str, cache: int | None = None, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        self.model = self.library.model.tokenize
        self.stretches = Known(self.of_stretch, cache or self.remembered)

    def of_piece(self, s: str) -> bytes:
        """Ids of what the vocabulary's pattern leaves whole."""
        if not (s.isascii() and s.isprintable() and s[0] != " "):
            s = "".join([self.letters[b] for b in s.encode()])
        return array("H", [t.id for t in self.model(s)]).tobytes()

    def of_stretch(self, s: str) -> bytes:
        if s.isascii() and s.isalpha():
            return self.of_piece(s)
        cut = self.plain.findall(s)
        if sum(map(len, cut)) != len(s) or s[-1:] in {" ", "\n"}:
            return self.whole(s)
        return b"".join(map(self.stretches.__getitem__, cut)) if len(cut) > 1 else self.of_piece(s) if s else b""

    def rest(self, left: int) -> None:
        """Between tasks: keep ``left`` of what is known, the earliest."""
        self.stretches.trim(left)

    def whole(self, s: str) -> bytes:
        return array("H", self.library.encode(s, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Null texts count as empty."""
        special, encode = self.special, self.encode
        return [self.whole(t) if any(map(t.__contains__, special)) else encode(t) for t in (t or "" for t in texts)]

    def encode(self, text: str) -> bytes:
        raise NotImplementedError


class WordEncoder(Encoder):
    """For vocabularies that drop white space and case: no token crosses a space or a line feed."""

    plain = re.compile(f"[{STABLE}]+|[0-9]|[{SIGNS}]+")
    remembered = 600_000

    def encode(self, text: str) -> bytes:
        cut = text.encode().lower().decode().replace("\n", " ").split(" ")  # ASCII letters only; the library folds the rest
        return b"".join(map(self.stretches.__getitem__, cut))


class Beside(Exception):
    """White space beside a space: there, where the runs of white space belong depends on more than one stretch."""


class ByteEncoder(Encoder):
    """For byte-level vocabularies: a space between two characters that are not white space starts a new token."""

    plain = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n+(?=\s)|\n")
    joints = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.spaced = Known(self.after_space, self.stretches.most)  # by what follows the space

    def rest(self, left: int) -> None:
        super().rest(left)
        self.spaced.trim(left)

    def after_space(self, s: str) -> bytes:
        if s.isascii() and s.isalpha():
            return array("H", [t.id for t in self.model(self.letters[32] + s)]).tobytes()
        if not s or s[-1].isspace():
            raise Beside
        first, *rest = self.plain.findall(" " + s) or [""]
        if len(first) + sum(map(len, rest)) != len(s) + 1:
            return self.whole(" " + s)
        return self.spaced[first[1:]] + b"".join(map(self.stretches.__getitem__, rest)) if rest else self.of_piece(first)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Beside
            return self.stretches[first] + b"".join(map(self.spaced.__getitem__, rest))
        except Beside:
            return b"".join(map(self.stretches.__getitem__, self.joints.split(text)))


@lru_cache(maxsize=4)
def encoder_of(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each worker process: what one task has learnt serves the next one there."""
    return kind(path)
