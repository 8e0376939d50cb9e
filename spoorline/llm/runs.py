"""Periodic runs of words, by a suffix automaton and link-cut access.

**Runs.** A run is a stretch of consecutive words with smallest period q, at least
``LEAST_WORDS`` and 2 q words long, that no neighbouring word extends. The automaton's
states hang in the tree of suffix links. Appending word i recolours the path from the
state of the text so far to the root with i; the path falls into segments by the colour
they had, which is where those suffixes last ended. A segment last seen at e whose
deepest state has length m says that the m words before and up to i repeat at distance
q = i - e and no more than m do. With q <= m they hold a square of period q, whose run
starts at i - m - q + 1. The suffix of q words of a run recurs first at distance q, as a
shorter distance would give the run a shorter period, so every end of the run tells it,
the last one its full length. Segments are the preferred paths of link-cut trees, kept
as splay trees, so that all recolouring together takes O(n log n) steps.

**Where the automaton runs.** A run of length L has L - q - 5 consecutive six-word
shingles that also stand at most q words before, and q <= L - q. ``stretches`` keeps the
chains of repeated shingles that are long enough for the distance at which they repeat,
widened by that distance on the left. A run lies in one stretch with its whole length,
so that no run is lost or cut; only words that cannot be in a run are passed over.

Defined results: null and empty texts have no words and no runs. Words are divided by
ASCII white space only. Rows are independent, so repeated rows, null ids and empty
tables need no care; other columns are not looked at. A text is the unit of work: memory
follows its longest periodic stretch (about 1 KB a word), time is O(n log n) in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 12
#: Words that every run repeats at the distance of its period.
SHINGLE = LEAST_WORDS // 2

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class SuffixAutomaton:
    """States of a word sequence: longest length, suffix link, and the state of each prefix."""

    def __init__(self, ids: list[int]):
        self.length, self.link, self.prefixes = [0], [-1], []
        length, link, ways, last = self.length, self.link, [{}], 0
        for i, c in enumerate(ids):
            state = len(length)
            length.append(i + 1)
            ways.append({})
            p = last
            while p >= 0 and c not in ways[p]:
                ways[p][c] = state
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = ways[p][c]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    clone = state + 1
                    link.append(clone)
                    length.append(length[p] + 1)
                    ways.append(ways[q].copy())
                    link.append(link[q])
                    link[q] = clone
                    while p >= 0 and ways[p].get(c) == q:
                        ways[p][c] = clone
                        p = link[p]
            self.prefixes.append(state)
            last = state


class Paths:
    """The link tree in preferred paths, each with the end at which it was last seen.

    A path is a splay tree by depth, and its colour stands at the splay tree's root.
    Node 0 stands for none, so states are counted from 1 here.
    """

    def __init__(self, link: list[int]):
        n = len(link) + 1
        self.above = [0, *(x + 1 for x in link)]
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def splay(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        while True:
            p = above[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = above[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self.rotate(p)
                self.rotate(x)
            else:
                self.rotate(x)
                if inner:
                    self.rotate(x)

    def rotate(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        p = above[x]
        g = above[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            above[inner] = p
        above[p], above[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolours the way from a state to the root: (state, its last end) by segment, deepest first."""
        above, right, colour, splay = self.above, self.right, self.colour, self.splay
        below, x, segments = 0, state + 1, []
        while x:
            splay(x)
            seen, deeper = colour[x], right[x]
            if deeper:
                colour[deeper] = seen
            right[x] = below
            if seen >= 0:
                segments.append((x - 1, seen))
            below, x = x, above[x]
        colour[below] = end
        splay(state + 1)
        return segments


def runs_of(ids: list[int]) -> dict[tuple[int, int], int]:
    """Length by (start, period) of every maximal stretch that is at least two periods long."""
    automaton = SuffixAutomaton(ids)
    paths, length, found = Paths(automaton.link), automaton.length, {}
    for end, state in enumerate(automaton.prefixes):
        for deepest, seen in paths.access(state, end):
            period, shared = end - seen, length[deepest]
            if period <= shared:
                found[end - shared - period + 1, period] = shared + period
    return found


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (first, last) word numbers that hold all runs of ``LEAST_WORDS`` or more."""
    n = len(ids) - SHINGLE + 1
    if n <= 1:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    shingles = mixed[:n].copy()
    for k in range(1, SHINGLE):
        shingles = shingles * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n + k]
    order = np.argsort(shingles, kind="stable")
    same = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    if not len(same):
        return []
    distance = np.zeros(n, dtype=np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    at = np.sort(order[same + 1])
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
        size = np.diff(first, append=len(at))
        room = np.repeat(size, size) + SHINGLE - 1
        near = distance[at] <= room
        if near.all():
            break
        at = at[near]
    else:
        return []
    starts = np.maximum(at[first] - (size + SHINGLE - 1), 0)
    found: list[tuple[int, int]] = []
    for start, last in zip(starts.tolist(), (at[first + size - 1] + SHINGLE - 1).tolist(), strict=True):
        while found and start <= found[-1][1] + 1:
            start, last = min(start, found[-1][0]), max(last, found[-1][1])
            found.pop()
        found.append((start, last))
    return found


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    if len(words) < LEAST_WORDS:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for first, last in stretches(ids):
        for (start, period), length in runs_of(ids[first : last + 1].tolist()).items():
            if length >= LEAST_WORDS:
                found.append((first + start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    turn = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        turn[start + period] += 1
        turn[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()
    return b" ".join(map(words.__getitem__, kept))


def repeated(words: list[bytes], seed: int) -> list[bytes]:
    """One text in ten, by its seed, repeats some of its words from a place on to its end."""
    if seed % 10 or not words:
        return words
    n, g = len(words), seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@F.pandas_udf(FOUND)
def _analysed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, seeds in batches:
        listed, shown = [], []
        for text, seed in zip(texts, seeds, strict=True):
            words = (text or "").encode().split()
            if seed >= 0:
                words = repeated(words, int(seed))
            found = runs(words)
            listed.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            shown.append(collapsed(words, found).decode())
        yield pd.DataFrame({"runs": listed, "collapsed": shown}, dtype=object)


def analysed(text: str | Column, seed: Column | None = None) -> Column:
    """``runs`` and ``collapsed`` of a text; with a ``seed``, of the text that ``repeated`` makes of it."""
    return _analysed(text, F.lit(-1).cast("long") if seed is None else seed.cast("long"))
