"""Passages of held-out test items inside a corpus.

Texts are reduced to their words in lower case, one space apart. Character q-grams of a document are
looked up among those of the items; hits are counted per item in overlapping bands of diagonals. By
the q-gram lemma two stretches of ``m`` characters within ``edits`` edits share at least
``m + 1 - q * (edits + 1)`` q-grams in one band; bands below that bound, with ``m`` the least length
that ``words`` words of that very item have, hold no passage. The others are aligned within their
band, and the aligned region must hold ``words`` equal consecutive words.

The items are a stated query set. They go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
EDITS = 1
BAND = 8
_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """The words of a text (runs of letters or digits) in lower case, one space apart; empty for null."""
    return " ".join(_WORD.findall(text.lower())) if isinstance(text, str) else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, by its start."""
    n = max(0, len(codes) - Q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = (out ^ codes[k : k + n].astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(29)
    return out


class ItemIndex:
    """The q-grams of one block of items, sorted, with the item and place of each."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        kept = [(i, t) for i, t in items if t.count(" ") + 1 >= words]
        self.ids = [i for i, _ in kept]
        self.words = words
        self.texts = [t for _, t in kept]
        codes = [_codes(t) for t in self.texts]
        grams = [_qgrams(c) for c in codes]
        owner = np.repeat(np.arange(len(kept)), [len(g) for g in grams]) if kept else np.zeros(0, int)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if kept else np.zeros(0, int)
        every = np.concatenate(grams) if kept else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.bound = np.array([max(1, _least(t, words) + 1 - Q * (EDITS + 1)) for t in self.texts], np.int64)
        self.runs = [_shingles(t, words) for t in self.texts]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, diagonals, places of the hits) of each band that meets its item's bound."""
        if not len(self.grams) or len(codes) < Q:
            return
        grams = _qgrams(codes)
        slot = np.searchsorted(self.grams, grams)
        slot[slot == len(self.grams)] = 0
        at = np.flatnonzero(self.grams[slot] == grams)
        if not len(at):
            return
        many = self.count[slot[at]]
        where = np.repeat(at, many)
        inner = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        hit = np.repeat(self.first[slot[at]], many) + inner
        item, shift = self.owner[hit].astype(np.int64), self.place[hit].astype(np.int64) - where
        base = shift + len(codes) + BAND
        width = (2 * len(codes) + max(map(len, self.texts)) + 3 * BAND) // BAND + 2
        # Each band reaches EDITS diagonals into the next, so a region with its edits lies within one.
        low = item * width + base // BAND
        twice = np.flatnonzero(base % BAND < EDITS)
        key = np.concatenate((low, low[twice] - 1))
        spot = np.concatenate((where, where[twice]))
        diagonal = np.concatenate((shift, shift[twice]))
        order = np.argsort(key, kind="stable")
        key, spot, diagonal = key[order], spot[order], diagonal[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        stop = np.append(start[1:], len(key))
        enough = stop - start >= self.bound[key[start] // width]
        for s, e in zip(start[enough].tolist(), stop[enough].tolist()):
            yield int(key[s] // width), diagonal[s:e], spot[s:e]

    def leaks(self, text: str) -> set[int]:
        """The ids of the items that share ``words`` consecutive words with a normal text."""
        codes = _codes(text)
        found: set[int] = set()
        for item, diagonals, spots in self.candidates(codes):
            if self.ids[item] in found:
                continue
            other = self.texts[item]
            for low, high in _regions(text, other, diagonals, spots):
                low = text.rfind(" ", 0, low + 1) + 1 if low else 0
                high = text.find(" ", high) if text.find(" ", high) >= 0 else len(text)
                if not self.runs[item].isdisjoint(_shingles(text[low:high], self.words)):
                    found.add(self.ids[item])
                    break
        return found


def _least(text: str, words: int) -> int:
    """The least number of characters of ``words`` consecutive words."""
    ends = [m.span() for m in _WORD.finditer(text)]
    return min(ends[i + words - 1][1] - ends[i][0] for i in range(len(ends) - words + 1))


def _shingles(text: str, words: int) -> set[str]:
    all_words = text.split(" ")
    return {" ".join(all_words[i : i + words]) for i in range(len(all_words) - words + 1)}


def _regions(text: str, other: str, diagonals: np.ndarray, spots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` that align with ``other`` within the band's edits, grown from runs of hits."""
    done = -1
    order = np.argsort(spots, kind="stable")
    for spot, diagonal in zip(spots[order].tolist(), diagonals[order].tolist()):
        if spot < done:
            continue
        right = spot + _reach(text[spot:], other[spot + diagonal :])
        left = spot - _reach(text[:spot][::-1], other[: spot + diagonal][::-1])
        yield left, right
        done = max(done, right - Q + 1)


def _reach(a: str, b: str) -> int:
    """How far ``a`` aligns with the start of ``b`` with at most EDITS edits: furthest-reaching points by diagonal."""
    best = {0: _common(a, b, 0, 0)}
    far = best[0]
    for _ in range(EDITS):
        step: dict[int, int] = {}
        for d, i in best.items():
            for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if 0 <= ni <= len(a) and 0 <= ni + nd <= len(b):
                    step[nd] = max(step.get(nd, -1), ni + _common(a, b, ni, ni + nd))
        best = step or best
        far = max(far, *best.values())
    return min(far, len(a))


def _common(a: str, b: str, i: int, j: int) -> int:
    """The length of the common start of ``a[i:]`` and ``b[j:]``, by doubling and halving."""
    limit = min(len(a) - i, len(b) - j)
    low, step = 0, 16
    while low < limit:
        n = min(step, limit - low)
        if a[i + low : i + low + n] == b[j + low : j + low + n]:
            low += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
            limit = min(limit, low + n)
    return low


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 12, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id``: documents that share ``words`` consecutive words with an item.

    Null and empty texts leak nothing, items of fewer words cannot leak, a row given twice counts
    once. The items are read in as many blocks as keep each below about ``block_chars`` characters
    (30 bytes of index a character), whatever their number; no document is shuffled.
    """
    held = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    total = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    found = None
    for k in range(blocks):
        block = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], normal(r[1])) for r in block], words))

        def scan(batches, index=index):
            known = index.value
            for pdf in batches:
                out = [(d, i) for d, t in zip(pdf["doc_id"], pdf["text"]) for i in known.leaks(normal(t))]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        part = docs.where("text is not null").select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long")
        found = part if found is None else found.union(part)
    return found.distinct()
