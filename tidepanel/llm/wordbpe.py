"""Token ids of a BPE tokenizer that drops white space, word by word.

For a tokenizer file whose normaliser and splitter never look across white space, the ids of
a text are the ids of its words in a row.  Words met before come from a cache.  A text of Latin letters
and ASCII is lowered as a whole, and full stops and commas are set apart, so that "Word," and
"word." are the same word and a mark: the splitter parts them there anyway.  Other texts are
cut at white space only.  New words of letters go straight to the merges, all others through
the library.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Latin letters that are stable under NFC and whose lower case depends on no neighbour.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ɏ]+\Z")
UNUSUAL = re.compile(r"[^\t-\r -~À-ÖØ-öø-įı-ňŊ-ɏ]")
MARK_RUN = re.compile(r"[.,](?<=[!-/:-@\[-`{-~].)")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
CACHE = 200_000
LONGEST = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def word_by_word(settings: dict) -> bool:
    """Whether the file's steps are known to treat words between white space apart."""
    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part.get("type") == "Sequence" else [part]

    normal = {s["type"] for s in steps(settings.get("normalizer"), "normalizers")}
    split = steps(settings.get("pre_tokenizer"), "pretokenizers")
    drops = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"\s" in s["pattern"].get("Regex", "") for s in split)
    spaced = [t for t in settings.get("added_tokens", []) if t["single_word"] or len(t["content"].split()) != 1]
    return normal <= {"NFC", "Replace", "Lowercase"} and drops and not spaced


class Recent(dict):
    """A bounded cache in two generations.

    Full, it becomes the older generation and starts anew; what is asked for again moves back.
    So rare words leave, frequent ones stay, and never more than twice the limit is held.  Words
    over ``LONGEST`` characters are not held at all, so neither a text of one endless word nor many
    of them fill the memory.
    """

    def __init__(self, make: Callable, limit: int = CACHE):
        super().__init__()
        self.make = make
        self.limit = limit
        self.older: dict = {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Packed ids of words: two bytes each where the vocabulary allows, else four, little-endian."""

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        if not word_by_word(settings):
            raise ValueError(f"{path}: its words depend on their neighbours")
        self.kind = "H" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.letters = byte_letters()
        normal = settings["normalizer"] or {}
        kinds = {s["type"] for s in normal.get("normalizers", [normal]) if s}
        self.lowers = "Lowercase" in kinds and settings["model"].get("dropout") is None
        self.words = Recent(self.encoded, limit)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def encoded(self, word: str) -> bytes:
        """Ids of a word; one of plain letters is a single pre-token and needs the merges only."""
        if self.lowers and PLAIN.match(word):
            shown = word.lower()
            if not shown.isascii():
                shown = "".join(map(self.letters.__getitem__, shown.encode()))
            ids = [t.id for t in self.library.model.tokenize(shown)]
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        return self.packed(ids)

    def split(self, text: str) -> list[str]:
        """Words whose ids in a row are the ids of the text."""
        if not self.lowers or UNUSUAL.search(text) or MARK_RUN.search(text) or "<|" in text:
            return WORDS.findall(text)
        return text.lower().replace(".", " .").replace(",", " ,").split()

    def text(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(map(self.words.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)
