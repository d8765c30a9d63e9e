"""The parts of a word-end BPE tokenizer file that the operators compile: normaliser, splitter and merges."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import WHITE

#: Ids take this many bits where two numbers share one int; NONE: no merge.
BITS = 21
MASK = (1 << BITS) - 1
NONE = 1 << 62
_white = re.compile(f"[{WHITE}]").match
#: Splits normalised text into words; single letters after an apostrophe go with it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [stand[b] for b in range(256)]


def normal(text: str) -> str:
    """NFC, then each code point lower-cased by itself (no final sigma). Not for texts with `recent` code points."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=1)
def recent() -> tuple[frozenset[str], Callable[[str], object]]:
    """Code points that Python's Unicode tables don't know yet and newer ones do, and a quick look for any from their least on.

    On all others Python's tables, the regex package's and the library's agree; what these few are, the library is asked.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    new = frozenset(c for run in regex.findall(r"\P{Cn}+", every) for c in run if unicodedata.category(c) == "Cn")
    return new, re.compile(f"[{min(new)}-\U0010ffff]" if new else "(?!)").search


def has_recent(text: str) -> bool:
    new, look = recent()
    return not text.isascii() and look(text) is not None and not new.isdisjoint(text)


class WordBPE:
    """Vocabulary, merges and special strings of one tokenizer file."""

    def __init__(self, path: str):
        lib = Tokenizer.from_file(path)
        self.lib_normal, self.lib_split = lib.normalizer.normalize_str, lib.pre_tokenizer[0].pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: (left id, right id) -> rank and new id, each packed into one int, so that the least is the lowest rank.
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a] << BITS | self.vocab[b]] = r << BITS | self.vocab[a + b]
        #: The pairs by rank and new id, and the other way round in the order of pairs.
        self.pairs = {r: k for k, r in self.rank.items()}
        order = sorted(self.rank)
        self.sorted_ranks = np.array(order, np.int64), np.array([self.rank[k] for k in order], np.int64)
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(SPLIT).findall

    @cached_property
    def decimals(self) -> dict[int, str]:
        """Each id as text."""
        return {i: str(i) for i in self.tokens}

    def symbols(self, word: str) -> list[int]:
        """One symbol a byte; the last one ends the word."""
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        return [*(inner[b] for b in raw[:-1]), self.last[raw[-1]]]

    def normal(self, text: str) -> str:
        """The library's normalised text, but for how white space is written."""
        return self.lib_normal(text) if has_recent(text) else normal(text)

    def kind(self, c: str) -> str:
        """Of a normalised code point: L(etter), N(umber), W(hite space) or O(ther), as the library's splitter takes it."""
        if c in recent()[0]:
            before = [p for p, _ in self.lib_split("a" + c)], [p for p, _ in self.lib_split("!" + c)]
            return "L" if "a" + c in before[0] else "O" if "!" + c in before[1] else "N" if c in before[1] else "W"
        return "W" if _white(c) else "L" if c.isalpha() else "N" if unicodedata.category(c)[0] == "N" else "O"

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised."""
        if has_recent(text):
            return [w for w, _ in self.lib_split(self.lib_normal(text))]
        return self.words(normal(text))

    def parts(self, unit: str) -> list[tuple[bool, str]]:
        """A piece without white space as (is special, word) in order."""
        if self.cut is None or "<|" not in unit:
            return [(False, w) for w in self.split(unit)]
        found, at = [], 0
        for m in self.cut.finditer(unit):
            found += [(False, w) for w in self.split(unit[at : m.start()])]
            found.append((True, m[0]))
            at = m.end()
        return found + [(False, w) for w in self.split(unit[at:])]

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        return self.merged(self.symbols(word))

    def merged(self, s: list[int]) -> list[int]:
        """The symbols s merged: the lowest rank first, leftmost first among equals."""
        get = self.rank.get
        if len(s) > 64:
            return self._merge_long(s)
        ranks = [get(a << BITS | b, NONE) for a, b in pairwise(s)]
        while ranks and (best := min(ranks)) is not NONE:
            i = ranks.index(best)
            s[i : i + 2] = [new := best & MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(s[i - 1] << BITS | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << BITS | s[i + 1], NONE)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        n, get = len(s), self.rank.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (r := get(s[i] << BITS | s[i + 1], NONE)) is not NONE:
                heap.append((r, i, s[i], s[i + 1]))
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if s[i] == a else n
            if j >= n or s[j] != b:
                continue
            s[i], s[j] = best & MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := get(s[left] << BITS | s[right], NONE)) is not NONE:
                    heapq.heappush(heap, (r, left, s[left], s[right]))
        return [x for x in s if x >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)
