"""Byte-level BPE by pre-tokens: split as the library does, encode each distinct
pre-token once per worker.

Up to a bounded table of code points the splitting pattern is compiled from the
Unicode categories that every Unicode version agrees on; texts with other code
points go to the library whole, so that results never depend on the version.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

from arraylume.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LIMIT = 0x530  # the pattern below knows the code points before this one and U+2000-U+206F
#: Distinct pre-tokens that a worker keeps; longer pre-tokens are never kept.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(inside) -> str:
    known = [c for c in (*range(LIMIT), *range(0x2000, 0x2070)) if inside(chr(c))]
    return "".join(rf"\u{c:04x}" for c in known)


_LETTERS = _ranges(lambda c: unicodedata.category(c)[0] == "L")
_NUMBERS = _ranges(lambda c: unicodedata.category(c)[0] == "N")
_BLANKS = _ranges(lambda c: c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z")
PRETOKEN = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
UNKNOWN = re.compile(r"[^\x00-\u052f\u2000-\u206f]")

#: Tokenizers by path: loaded once per worker process.
_LOADED: dict = {}
_MODELS: dict = {}


def tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def checked(path: str | None = None) -> str:
    """The path, or an error if the file is no plain byte-level BPE."""
    path = path or default_path()
    form = json.loads(tokenizer(path).to_str())
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if form["normalizer"] or form["model"]["type"] != "BPE" or not wanted.items() <= (form["pre_tokenizer"] or {}).items():
        raise ValueError(f"{path} is no plain byte-level BPE")
    return path


def _byte_letters() -> dict[int, str]:
    """Bytes as the letters that byte-level vocabularies write them with: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTER_OF_BYTE = _byte_letters()


class Cache(dict):
    """Pre-token -> what ``make`` gives for its ids. Misses are merged by the
    library's model; the worker keeps a bounded number of them, in two generations,
    so that those in use stay."""

    def __init__(self, path: str, make, frequent=None) -> None:
        super().__init__(frequent or {})
        self.path, self.make, self.first = path, make, dict(frequent or {})
        self.own, self.before = 0, {}
        self.model = None

    def encode(self, text: str):
        """Of a whole text."""
        return self.make(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def __missing__(self, pretoken: str):
        value = self.before.get(pretoken)
        if value is None:
            if self.model is None:
                self.model = _MODELS.get(self.path) or _MODELS.setdefault(self.path, tokenizer(self.path).model)
            if pretoken.isascii() and pretoken.isprintable():  # all but the blank stand for themselves
                letters = pretoken.replace(" ", _LETTER_OF_BYTE[32])
            else:
                letters = pretoken.encode().decode("latin-1").translate(_LETTER_OF_BYTE)
            value = self.make([t.id for t in self.model.tokenize(letters)])
        if len(pretoken) <= CACHE_CHARS:
            if self.own >= CACHE_ENTRIES // 2:
                self.before = dict(self)
                self.clear()
                self.update(self.first)
                self.own = 0
            self[pretoken] = value
            self.own += 1
        return value


def specials(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Pattern and ids of the added tokens, longest first."""
    added = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    return (re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None), added


#: Worker caches by (path, kind).
CACHES: dict = {}


def cache(path: str, kind: str, make, frequent=None) -> Cache:
    if (path, kind) not in CACHES:
        CACHES[path, kind] = Cache(path, make, frequent)
    return CACHES[path, kind]


def splits(text: str, special):
    """(is special, piece) for the pieces of a text between added tokens."""
    if special is None or special.search(text) is None:
        return [(False, text)]
    return [(i % 2 == 1, x) for i, x in enumerate(special.split(text)) if x]


def _drop() -> None:
    for kept in (CACHES, _MODELS, _LOADED):
        kept.clear()


common.KEPT["bpe"] = _drop
