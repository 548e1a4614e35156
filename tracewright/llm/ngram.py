"""Byte n-gram counts over Arrow text, and frozen back-off tables that score whole texts.

A table holds, for each order, the cost in bits of every known n-gram, and for each known context the
cost of leaving it for the next shorter one. Both prediction by partial matching and interpolated
Kneser-Ney take this form once their counts are frozen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracewright.llm.common import chunks

START = 10  # what stands before the first byte of a text
STEP = 1 << 18  # positions that are scored at once
UNKNOWN_BITS = 8.0  # a byte that no order knows


def padded(data: np.ndarray, offsets: np.ndarray, order: int, lut: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each behind ``order - 1`` start bytes, and the first position of each text's own bytes."""
    lens, pad = np.diff(offsets), order - 1
    body = data[offsets[0] : offsets[-1]]
    out = np.full(len(body) + pad * len(lens), START, np.uint8)
    at = np.arange(len(body)) + np.repeat(pad * np.arange(1, len(lens) + 1), lens)
    out[at] = body if lut is None else lut[body]
    return out, (offsets[:-1] - offsets[0]) + pad * np.arange(1, len(lens) + 1)


def grams(text: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each position, one byte after another in an integer; the newest byte is lowest."""
    wide = text.astype(np.uint64)
    out = wide.copy()
    for back in range(1, order):
        out[back:] |= wide[:-back] << np.uint64(8 * back)
    return out


def backwards(gram: np.ndarray, order: int) -> np.ndarray:
    """The context of each gram of ``order`` bytes as a number whose highest byte is the newest: contexts that end alike are near."""
    out = np.zeros(len(gram), np.uint64)
    for i in range(order - 1):
        out |= ((gram >> np.uint64(8 * (i + 1))) & np.uint64(255)) << np.uint64(8 * (order - 2 - i))
    return out


def count_grams(data: np.ndarray, offsets: np.ndarray, order: int, lut: np.ndarray | None = None):
    """(gram, count) of the texts, a chunk of bounded size at a time."""
    for i, j in chunks(offsets):
        text, starts = padded(data, offsets[i : j + 1], order, lut)
        own = np.ones(len(text), bool)
        for back in range(1, order):
            own[starts - back] = False
        yield np.unique(grams(text, order)[own], return_counts=True)


class Summed:
    """Counts of one task, merged as chunks come and handed out whenever they exceed a bound."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            counts = np.concatenate([c for _, c in self.parts])
            unique, where = np.unique(keys, return_inverse=True)
            self.parts = [(unique, np.bincount(where, weights=counts).astype(np.int64))]
        self.size = sum(len(k) for k, _ in self.parts)

    def take(self, force: bool = False):
        if force or self.size > self.most:
            self.merge()
        if self.parts and (force or self.size > self.most // 2):
            out, self.parts, self.size = self.parts[0], [], 0
            return out
        return None


class KeyIndex:
    """Row numbers of unsigned 64-bit keys, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self.home(keys)
        while len(todo):
            free = self.rows[at[todo]] < 0
            _, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.rows[at[won]], self.keys[at[won]] = won, keys[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        out = self.rows[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.rows[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out


@dataclass
class Level:
    """Grams of ``size`` bytes; contexts are of ``size - 1``. One column for each model scored at once."""

    size: int
    keys: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    leave: np.ndarray


class Table:
    """Levels by size, from 1 up to the order.

    With a ``span`` the table knows only contexts that lie in it when read backwards, and scores only
    positions behind these: bits of tables whose spans cover all contexts once add up to those of the whole.
    """

    def __init__(self, levels: list[Level], span: tuple[int, int] | None = None):
        self.levels, self.order, self.span = levels, len(levels), span
        self.width = levels[0].cost.shape[1]
        self.index: list[KeyIndex] | None = None

    def plain(self) -> tuple:
        """What the table is made of, as built-in types and arrays; the indexes are built where they are used."""
        return [(x.size, x.keys, x.cost, x.contexts, x.leave) for x in self.levels], self.span

    @staticmethod
    def of(plain: tuple) -> "Table":
        return Table([Level(*x) for x in plain[0]], plain[1])

    def ready(self) -> None:
        if self.index is None:
            self.context_index = [KeyIndex(x.contexts) for x in self.levels]
            self.index = [KeyIndex(x.keys) for x in self.levels]

    def costs(self, top: np.ndarray) -> np.ndarray:
        """Bits of each position's byte under each model, from its highest-order gram."""
        total, todo = np.zeros((len(top), self.width), np.float32), np.arange(len(top))
        if self.span not in (None, (0, (1 << (8 * (self.order - 1))) - 1)):
            behind = backwards(top, self.order)
            todo = np.flatnonzero((behind >= np.uint64(self.span[0])) & (behind <= np.uint64(self.span[1])))
        for k in range(self.order - 1, -1, -1):
            keep = np.uint64((1 << (8 * (k + 1))) - 1)
            gram = top[todo] & keep
            row = self.index[k].find(gram)
            known = row >= 0
            total[todo[known]] += self.levels[k].cost[row[known]]
            todo, gram = todo[~known], gram[~known]
            if not len(todo):
                return total
            row = self.context_index[k].find(gram >> np.uint64(8))
            seen = row >= 0
            total[todo[seen]] += self.levels[k].leave[row[seen]]
        total[todo] += UNKNOWN_BITS
        return total

    def bits(self, data: np.ndarray, offsets: np.ndarray, lut: np.ndarray | None = None) -> np.ndarray:
        """Bits of each whole text under each model."""
        self.ready()
        out = np.zeros((len(offsets) - 1, self.width))
        for i, j in chunks(offsets, STEP):
            lens = np.diff(offsets[i : j + 1])
            text, starts = padded(data, offsets[i : j + 1], self.order, lut)
            top = grams(text, self.order)
            for a in range(0, len(top), STEP):  # one very long text is a chunk alone
                part = self.costs(top[a : a + STEP])
                run = np.concatenate([np.zeros((1, self.width)), np.cumsum(part, axis=0, dtype=np.float64)])
                lo, hi = np.clip(starts - a, 0, len(part)), np.clip(starts + lens - a, 0, len(part))
                out[i:j] += run[hi] - run[lo]
        return out

