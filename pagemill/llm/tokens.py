"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

Byte-level tokenizers never join anything across a single space between two characters that are not white space,
so a text is cut there, and around single line breaks, and each piece (with its leading space) is looked up. A piece that is not in the cache
and has only common Latin characters is split by the tokenizer's own expression, and its parts go straight to
the library's BPE model, which is several times faster than a full call for a short text; any other piece,
or one with the string of a special token, takes the full call. The ids are those of the whole text; tests compare them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

import public_tokenizers  # noqa: E402
import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s").search
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]+").fullmatch
_SEGMENT = 1 << 20
_LOADED: dict[str, Encoder] = {}


def _alphabet() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Ids by piece, made when first asked for. Two generations; the older one is given up when the newer is full."""

    def __init__(self, size: int, make: Callable[[str], bytes]) -> None:
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        return self.put(piece, self.make(piece) if ids is None else ids)

    def put(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Text to little-endian unsigned 32-bit ids."""

    def __init__(self, spec: str, cache_size: int = 650_000, literal: bool = False) -> None:
        """``literal``: strings of special tokens in a text are ordinary text; else they give the special ids, as in a plain call."""
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = literal
        special = [] if literal else [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.has_special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.model = self.tokenizer.model
        self.pieces = _Cache(cache_size, self._ids)
        self.table = _alphabet()
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.lower, self.split = self._short_way(json.loads(spec))
        self.spaced = bool(self.split and self.split.fullmatch(" a"))  # a space begins its word

    @staticmethod
    def _short_way(spec: dict) -> tuple[bool, regex.Pattern | None]:
        """Whether texts are lower-cased, and the expression that splits them; None if this tokenizer is of another kind."""
        normalizer, steps = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in normalizer.get("normalizers", [])] if normalizer else []
        if spec["model"]["type"] != "BPE" or kinds not in ([], ["NFC", "Replace", "Lowercase"]) or (normalizer and not kinds):
            return False, None
        if steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space"):
            return bool(kinds), regex.compile(public_tokenizers.PATTERN)
        steps = steps.get("pretokenizers", [])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]:
            return bool(kinds), regex.compile(steps[0]["pattern"]["Regex"])
        return False, None

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """One encoder per worker process and tokenizer."""
        if spec not in _LOADED:
            _LOADED[spec] = cls(spec)
        return _LOADED[spec]

    def _parts(self, piece: str) -> list[str]:
        """The piece as the tokenizer splits it; a word alone or before a comma or stop needs no expression."""
        if self.lower:
            piece = piece.lower()
        word = piece[1:] if piece[0] == " " else piece
        begun = piece if self.spaced else word
        if word.isalpha():
            return [begun]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return [begun[:-1], word[-1]]
        return self.split.findall(piece)

    def _short(self, part: str) -> bytes:
        """Ids of one part as the tokenizer splits texts, by its BPE model."""
        plain = part.isascii() and part.isprintable()
        mapped = part.replace(" ", "\u0120") if plain else part.encode().decode("latin-1").translate(self.table)
        as_bytes = self.as_bytes
        return b"".join([as_bytes[t.id] for t in self.model.tokenize(mapped)])

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece. Its parts are kept like pieces, since they are ones elsewhere."""
        common = (piece.isascii() and piece.isprintable() and piece) or _COMMON(piece)
        if not (self.split and common) or self.has_special(piece):
            return b"".join([self.as_bytes[i] for i in self.tokenizer.encode(piece, add_special_tokens=False).ids])
        parts = self._parts(piece)
        return self._short(parts[0]) if len(parts) == 1 else b"".join([self._part(q) for q in parts])

    def _part(self, part: str) -> bytes:
        key = part if self.spaced else " " + part
        ids = self.pieces.get(key)
        if ids is None:
            ids = self.pieces.old.get(key)
            ids = self.pieces.put(key, self._short(part) if ids is None else ids)
        return ids

    @staticmethod
    def _segments(text: str) -> Iterator[str]:
        """Stretches of about a million characters, cut where pieces may be cut."""
        at = 0
        while len(text) - at > 2 * _SEGMENT and (m := _CUT.search(text, at + _SEGMENT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    @staticmethod
    def _pieces(segment: str) -> list[str]:
        if "\0" not in segment and not _DOUBLE(segment):
            # White space stands alone everywhere: a line break is a piece of its own, a space begins one.
            return segment.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        first, *rest = _CUT.split(segment)
        return [first, *[" " + p for p in rest]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; each piece is looked up once."""
        look_up = self.pieces.__getitem__
        for text in texts:
            yield b"".join([b"".join(map(look_up, self._pieces(s))) for s in self._segments(text)])
