"""Splitting texts into the words that a tokenizer file encodes one by one.

A tokenizers file of kind BPE cuts a text at its added tokens, normalises it,
splits it by a pattern and encodes each word on its own, so a word's ids do not
depend on where it stands. ``Splitter`` gives a text's words; ``ids`` encodes
one. Texts whose characters all lie below U+0180 are split by an equivalent
``re`` pattern built from the Unicode categories; all others, and texts that
may hold an added token, go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

LIMIT = 0x180             # below it nothing composes, and lower-casing is per character


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LIMIT) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0"                 # Unicode White_Space below U+0180
_SHORT = "'(?:s|t|re|ve|m|ll|d)"


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Splitter:
    """Words of a text, and ids of a word, for one tokenizers file."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.tok.model
        self.chars = byte_chars()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lower = spec["normalizer"] is not None
        letter, number = _class("L"), _class("N")
        # letters first: no other alternative can start where they do
        if self.lower:                     # white space dropped, digits one by one
            pattern = f"[{letter}]+|{_SHORT}|[{number}]|[^{_SPACE}{letter}{number}]+"
        else:
            pattern = (f" ?[{letter}]+|{_SHORT}| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
                       f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.find = re.compile(pattern).findall
        self.far = re.compile(f"[^\\x00-{chr(LIMIT - 1)}]").search

    def words(self, text: str) -> list[str] | None:
        """Words of a text; None where the library has to encode it whole."""
        if self.far(text) or any(a in text for a in self.added):
            return None
        return self.find(text.lower() if self.lower else text)

    def pieces(self, text: str) -> list[str]:
        """Words of any text, for a tokenizer without a normaliser. An added
        token is a piece of its own; no other piece spells one."""
        found = self.words(text)
        if found is not None:
            return found
        out: list[str] = []
        cut = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        for part in re.split(f"({cut})", text) if cut else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                out += [part[s:e] for _, (s, e) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def ids(self, word: str) -> list[int]:
        """Ids of one word: the model's merges over its bytes' characters."""
        if word in self.added:
            return [self.added[word]]
        return [t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, word.encode())))]

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    """One per Python worker and file."""
    return Splitter(path)


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file (never copied into here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Ids of words as little-endian bytes, each encoded when first met; the
    words given at the start stay, others are forgotten beyond ``most``."""

    def __init__(self, split: Splitter, dtype: str, start: dict[str, bytes] | None = None,
                 most: int = 300_000):
        super().__init__(start or {})
        self.split, self.dtype, self.start, self.most = split, dtype, start or {}, most

    def __missing__(self, word: str) -> bytes:
        import numpy as np

        if len(self) >= len(self.start) + self.most:
            self.clear()
            self.update(self.start)
        found = self[word] = np.array(self.split.ids(word), self.dtype).tobytes()
        return found

    def encode(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))
