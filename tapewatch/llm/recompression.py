"""Run-length grammars by recompression, and extension queries on them.

A sequence of numbers is compressed in rounds, block compression and pair compression in turn, until a round
changes nothing. Block compression replaces each maximal run of one symbol by one symbol for (symbol, length). Pair
compression deals the symbols into left and right ones and replaces each left symbol with a right one after it by one
symbol for the pair; such pairs never overlap. Equal rules get equal symbols, and whether two neighbours are joined
depends on nothing but their symbols. So equal stretches are compressed alike but for a few symbols at their ends.

Negative numbers are walls: they are never joined with anything, so sequences with a wall between them are compressed
side by side. No two walls may be equal; an extension never crosses one.

The longest common extension of two places climbs as long as both places are where a symbol of the next level begins,
with at most one step aside per level, and descends from the first difference. At each level the common part is known
at once: a block has a count, and a pair differs in its first or in its second symbol. Many queries go together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """A level's symbols, and how they lie in the level above it.

    `symbols` has one more entry than the level has symbols, for the end. `above[i]` is the symbol of the next level that
    holds symbol i; `left` is the first symbol of each symbol above, with the end.
    """

    symbols: np.ndarray
    above: np.ndarray | None = None
    left: np.ndarray | None = None
    blocks: bool = False


def _names(first: np.ndarray, second: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """New symbols, equal for equal (first, second)."""
    if not len(first):
        return np.zeros(0, np.int64), start
    key = first * (int(second.max()) + 1) + second
    _, name = np.unique(key, return_inverse=True)
    return start + name.ravel(), start + int(name.max()) + 1


def _parted(first: np.ndarray, second: np.ndarray, symbols: int, round_: int) -> np.ndarray:
    """Whether a symbol is a left one: drawn at random, the better way round of the two for the pairs there are."""
    side = np.random.default_rng(round_).integers(0, 2, symbols).astype(bool)
    ahead = np.count_nonzero(side[first] & ~side[second])
    behind = np.count_nonzero(~side[first] & side[second])
    return side if ahead >= behind else ~side


class Grammar:
    """Levels of a sequence; see the module's docstring."""

    def __init__(self, sequence: np.ndarray):
        self.levels = [Level(np.append(sequence, np.iinfo(np.int64).min))]
        fresh, idle, round_ = int(sequence.max(initial=0)) + 1, 0, 0
        while idle < 2:
            symbols = self.levels[-1].symbols
            plain = symbols >= 0
            joins, fresh = self._pairs(symbols, plain, fresh, round_) if round_ % 2 else self._blocks(symbols, fresh)
            idle = 0 if joins else idle + 1
            # Where no neighbours are left that a wall doesn't part, nothing can be joined any more.
            idle = 2 if not (plain[1:] & plain[:-1]).any() else idle
            round_ += 1

    def _append(self, starts: np.ndarray, named: np.ndarray, blocks: bool) -> None:
        level = self.levels[-1]
        level.above = (np.cumsum(starts) - 1).astype(np.int32)
        level.left = np.flatnonzero(starts).astype(np.int32)
        level.blocks = blocks
        self.levels.append(Level(named))

    def _blocks(self, symbols: np.ndarray, fresh: int) -> tuple[bool, int]:
        starts = np.append(True, symbols[1:] != symbols[:-1])
        if starts.all():
            return False, fresh
        left = np.flatnonzero(starts)
        size = np.diff(np.append(left, len(symbols)))
        named = symbols[left]
        many = np.flatnonzero(size > 1)
        named[many], fresh = _names(named[many], size[many], fresh)
        self._append(starts, named, True)
        return True, fresh

    def _pairs(self, symbols: np.ndarray, plain: np.ndarray, fresh: int, round_: int) -> tuple[bool, int]:
        both = np.flatnonzero(plain[:-1] & plain[1:])
        if not len(both):
            return False, fresh
        # Symbols as small numbers, so that the sides take no more room than the level.
        kinds, small = np.unique(symbols, return_inverse=True)
        small = small.ravel()
        side = _parted(small[both], small[both + 1], len(kinds), round_)
        first = both[side[small[both]] & ~side[small[both + 1]]]
        if not len(first):
            return True, fresh  # another draw may join some
        starts = np.ones(len(symbols), bool)
        starts[first + 1] = False
        named = symbols.copy()
        named[first], fresh = _names(small[first], small[first + 1], fresh)
        self._append(starts, named[starts], False)
        return True, fresh

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence agrees with itself from a and from b on; a != b."""
        return _extend([(v.symbols, v.above, v.left, v.blocks) for v in self.levels], a, b)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it agrees before a and before b, both left out."""
        turned = []
        for i, v in enumerate(self.levels):
            n = len(v.symbols) - 1
            symbols = np.append(v.symbols[:n][::-1], v.symbols[n])
            if v.above is None:
                turned.append((symbols, None, None, False))
                continue
            m = len(self.levels[i + 1].symbols) - 1
            above = np.append(m - 1 - v.above[:n][::-1], m)
            left = np.append(n - v.left[1:][::-1], n)
            turned.append((symbols, above, left, v.blocks))
        n = len(self.levels[0].symbols) - 1
        return _extend(turned, n - a, n - b)


def _extend(levels: list[tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Climb all queries together, then take them down level by level."""
    start, a, b = np.asarray(a, np.int64), np.array(a, np.int64), np.array(b, np.int64)
    end = a.copy()
    down: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries that stop climbing at a level, and their places
    open_ = np.arange(len(a))
    for symbols, above, left, blocks in levels:
        differ = symbols[a] != symbols[b]
        if above is not None:
            aside = ~differ & ((left[above[a]] != a) | (left[above[b]] != b))
            if blocks:
                # The rest of a block in which a place lies, or of the block that begins there.
                rest_a, rest_b = (left[np.minimum(above[x] + 1, len(left) - 1)] - x for x in (a, b))
                step = np.where(aside, np.minimum(rest_a, rest_b), 0)
                differ |= aside & (rest_a != rest_b)
            else:
                step = aside.astype(np.int64)
            a, b = a + step, b + step
        else:  # the top: a symbol has a wall or the end after it
            a, b = a + ~differ, b + ~differ
            differ[:] = True
        down.append((open_[differ], a[differ], b[differ]))
        if above is not None:
            a, b, open_ = above[a[~differ]].astype(np.int64), above[b[~differ]].astype(np.int64), open_[~differ]
    ids, a, b = down[-1]
    for (symbols, above, left, blocks), (more, more_a, more_b) in zip(levels[-2::-1], down[-2::-1]):
        a, b = left[a].astype(np.int64), left[b].astype(np.int64)
        same = symbols[a] == symbols[b]
        if blocks:
            size_a, size_b = (left[np.minimum(above[x] + 1, len(left) - 1)] - x for x in (a, b))
            step = np.where(same, np.minimum(size_a, size_b), 0)
        else:
            step = same.astype(np.int64)
        ids, a, b = np.append(ids, more), np.append(a + step, more_a), np.append(b + step, more_b)
    end[ids] = a
    return end - start
