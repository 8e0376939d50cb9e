"""Token counts of texts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character;
dynamic programming carries, per character, the best score and the number of pieces on
that path. Ties follow the tokenizer libraries: paths are extended from left to right
and only a strictly better one replaces another, so the piece that begins first stays. A
character that is no piece costs the smallest score less ten, and a run of such
characters is one token.

Spaces are read as the vocabulary's space mark, and one is put before the text. No piece
holds a mark behind another character, so the best path of a text is that of its words
one after the other; words are remembered within a bound, and memory does not grow with
the text: only the longest piece's reach is carried.

Defined results: a null or empty text has no tokens and score 0; rows are independent,
so repeated rows and null ids need no care; other columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Below the smallest score: the price of an unknown character (fixed value).
UNKNOWN_PENALTY = 10.0
MEMO_CHARS = 48
MEMO_SIZE = 200_000

RESULT = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("n_unknown", T.LongType()), T.StructField("score", T.DoubleType())]
)


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file and their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_byte, model.is_unknown, model.is_unused)
    ids = (i for i in range(model.vocab_size()) if not any(s(i) for s in special))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            self.trie.add_word(piece, (len(piece), score))
        if pieces:
            self.trie.make_automaton()
        self.pieces = bool(pieces)
        self.reach = max((len(p) for p, _ in pieces), default=1) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        words_apart = any(p == MARK for p, _ in pieces) and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if words_apart else re.compile(r"(?s).+")
        #: Words counted before, in two generations so that their number stays bounded.
        self.memo: dict[str, tuple[int, int, float]] = {}
        self.older: dict[str, tuple[int, int, float]] = {}

    def word(self, text: str) -> tuple[int, int, float]:
        """``path`` of a short text, which may keep all its places."""
        n, floor = len(text), float("-inf")
        best, start, unknown = [0.0] + [floor] * n, [0] * (n + 1), self.unknown
        strange = [False] * (n + 1)
        at, single = 0, True  # the place that matches now lead to
        for end, (size, score) in self.trie.iter(text) if self.pieces else ():
            while at <= end:
                if not single and best[at - 1] + unknown > best[at]:
                    best[at], start[at], strange[at] = best[at - 1] + unknown, at - 1, True
                at, single = at + 1, False
            if size == 1:
                single = True
            reached = best[at - size] + score
            if reached > best[at]:
                best[at], start[at] = reached, at - size
        while at <= n:
            if not single and best[at - 1] + unknown > best[at]:
                best[at], start[at], strange[at] = best[at - 1] + unknown, at - 1, True
            at, single = at + 1, False
        tokens = odd = 0
        place, behind = n, False
        while place:
            own = strange[place]
            if not (own and behind):  # a run of unknown characters is one token
                tokens, odd = tokens + 1, odd + own
            place, behind = start[place], own
        return tokens, odd, best[n]

    def path(self, text: str) -> tuple[int, int, float]:
        """(tokens, unknown tokens, score) of the best path through a text.

        ``best``, ``count``, ``strange`` and ``open`` (the last token is an unknown run) are
        kept for the last ``reach`` places only.
        """
        reach = self.reach
        best, count, strange, unknown = [0.0] * reach, [0] * reach, [0] * reach, [False] * reach
        ends = iter(self.trie.iter(text)) if self.pieces else iter(())
        end, found = next(ends, (len(text), None))
        for i in range(len(text)):
            at, single = (i + 1) % reach, False
            top, start, own = None, 0, False
            matches = []
            while end == i and found is not None:
                matches.append(found)
                end, found = next(ends, (len(text), None))
            for size, score in sorted(matches, reverse=True):  # the piece that begins first
                single = single or size == 1
                reached = best[(i + 1 - size) % reach] + score
                if top is None or reached > top:
                    top, start = reached, (i + 1 - size) % reach
            if not single:
                reached = best[i % reach] + self.unknown
                if top is None or reached > top:
                    top, start, own = reached, i % reach, True
            new = not (own and unknown[start])
            best[at], count[at], strange[at] = top, count[start] + new, strange[start] + (own and new)
            unknown[at] = own
        last = len(text) % reach
        return count[last], strange[last], best[last]

    def count(self, text: str | None) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        tokens, strange, total, memo = 0, 0, 0.0, self.memo
        for word in self.words.findall(MARK + text.replace(" ", MARK)):
            found = memo.get(word)
            if found is None:
                if len(word) > MEMO_CHARS:
                    found = self.path(word)
                else:
                    found = self.older.get(word) or self.word(word)
                    if len(memo) >= MEMO_SIZE:
                        self.older = dict(memo)
                        memo.clear()
                    memo[word] = found
            tokens, strange, total = tokens + found[0], strange + found[1], total + found[2]
        return tokens, strange, total


@functools.lru_cache(maxsize=2)
def _counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(pieces))


def counter(spark: SparkSession, pieces: list[tuple[str, float]]):
    """A column function from text to (n_tokens, n_unknown, score) for a vocabulary.

    The pieces travel with a broadcast of the vocabulary's size.
    """
    shipped = spark.sparkContext.broadcast(tuple(pieces))

    @F.pandas_udf(RESULT)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _counter(shipped.value)
        for texts in batches:
            yield pd.DataFrame([own.count(t) for t in texts], columns=RESULT.names)

    return count
