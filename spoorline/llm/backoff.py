"""Scores of texts under an interpolated n-gram model, as a weighted backoff automaton.

**Model.** The unigram is add-one over the training tokens. An n-gram's probability is
``(1 - b) c(hw) / c(h) + b p(w | shorter h)``; the weight b is the share of once-seen
n-grams (the Good-Turing estimate of new ones) among training n-grams whose context ends
in a word of the same length class. As an automaton, contexts seen in training are
states, seen n-grams are arcs with their full log probability, and every state has a
failure arc of weight log10 b to its shorter context. A text is read once from left to
right, carrying the state and adding up weights.

**Scale.** The model grows with the corpus and is never whole anywhere. Texts are
tokenised once into blocks of bounded size. A block asks for the counts of its distinct
n-grams; requests are dealt out by hash, so a frequent n-gram costs one entry a block,
and arrive where training counts are summed; the answers go back and the block builds
the part of the automaton that its texts can reach, which gives the same scores as the
whole. N-grams are 64-bit hashes, sorted and delta-coded in packs.

Defined results: a null text is empty and has only its end token; texts without
training data score by the unigram of nothing (one token in one); a null doc_id counts
as the empty text for the fold; repeated rows are scored, and learned from, each. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.text import mix
from spoorline.session import stored

END, BEGIN = (xxhash.xxh3_64_intdigest(b"", seed=s) for s in (1, 2))
#: Characters of a block, and requested n-grams that are summed in one task.
BLOCK_CHARS = 6 << 20
PART_KEYS = 4 << 20
#: Length classes of context words.
CLASSES = 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes change case and split at ASCII letters and spaces only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(doc_id: Column) -> Column:
    """The remainder that splits learning from held-out documents."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7


def _zip(a: np.ndarray) -> bytes:
    """Bytes by significance, so that the small ones compress."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def _unzip(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents (doc_id, held, text) in blocks of local word numbers."""
    first = TaskContext.get().partitionId() << 33
    number = 0

    def start():
        return {END: 0, BEGIN: 1}, [0, 0], [], [], [], [], 0

    known, classes, ids, held, sizes, found, chars = start()
    local: dict[bytes, int] = {}

    def block() -> pd.DataFrame:
        return pd.DataFrame(
            {
                "block": [first + number],
                "doc_ids": [ids],
                "held": [held],
                "sizes": [sizes],
                "words": [_zip(np.fromiter(known, np.uint64, len(known)))],
                "classes": [_zip(np.array(classes, np.uint8))],
                "tokens": [_zip(np.concatenate(found))],
                "n": [sum(sizes)],
            }
        )

    for batch in batches:
        for doc_id, out, text in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
            own = tokens(text)
            for w in set(own).difference(local):
                h = xxhash.xxh3_64_intdigest(w)
                if h not in known:
                    known[h] = len(known)
                    classes.append(min(len(w), CLASSES - 1))
                local[w] = known[h]
            found.append(np.array([*map(local.__getitem__, own), 0], np.uint32))
            ids.append(None if pd.isna(doc_id) else doc_id)
            held.append(bool(out))
            sizes.append(len(own) + 1)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield block()
                known, classes, ids, held, sizes, found, chars = start()
                local, number = {}, number + 1
    if ids:
        yield block()


class Block:
    """A block's tokens with their n-grams: distinct keys by order, and each token's."""

    def __init__(self, row, order: int):
        self.words, self.classes = _unzip(row.words, np.uint64), _unzip(row.classes, np.uint8)
        self.tokens, self.sizes = _unzip(row.tokens, np.uint32), np.array(row.sizes, np.int64)
        self.train = np.repeat(~np.array(row.held, bool), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.tokens)
        #: Words since the beginning of the text, before each token.
        self.depth = np.arange(n) - np.repeat(starts, self.sizes)
        self.before = np.where(self.depth > 0, np.roll(self.tokens, 1), 1)  # 1: the beginning
        hashed = self.words[self.tokens]
        self.grams = []
        keys, has = hashed, np.ones(n, bool)
        for k in range(1, order + 1):
            if k > 1:  # the n-gram is the shorter one that ends a token earlier, and this token
                older = np.roll(keys, 1)
                at_begin = self.depth == k - 2
                if k > 2:  # a context that starts with the beginning
                    older = np.where(at_begin, np.roll(opened, 1), older)
                else:
                    older = np.where(at_begin, np.uint64(BEGIN), older)
                keys = mix(older * STEP + hashed)
                has = self.depth >= k - 2
            opened = keys
            self.grams.append(self._distinct(keys, has))

    def _distinct(self, keys: np.ndarray, has: np.ndarray):
        place = np.flatnonzero(has)
        distinct, first, inverse = np.unique(keys[place], return_index=True, return_inverse=True)
        own = np.bincount(inverse, weights=self.train[place], minlength=len(distinct)).astype(np.uint32)
        at = np.full(len(keys), -1)
        at[place] = inverse
        return distinct, place[first], at, own


def requests(order: int, bits: int):
    """(n, part, block, keys, counts, classes): a block's n-grams by the top bits of the key."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                b = Block(row, order)
                for n, (keys, first, _, own) in enumerate(b.grams, 1):
                    classes = b.classes[b.before[first]]
                    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    cuts = [0, *edges, len(keys)]
                    rows = [
                        (n, p, row.block, _zip(np.diff(keys[s:e], prepend=np.uint64(0))), _zip(own[s:e]), _zip(classes[s:e]))
                        for p, (s, e) in enumerate(zip(cuts, cuts[1:]))
                        if e > s
                    ]
                    yield pd.DataFrame(rows, columns=["n", "part", "block", "keys", "counts", "classes"])

    return ask


def summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Training counts for every request of one part, in its order, and the part's statistics."""
    keys = [np.cumsum(_unzip(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    sizes = [len(k) for k in keys]
    _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    del keys
    own = np.concatenate([_unzip(c, np.uint32) for c in rows["counts"]])
    total = np.bincount(inverse, weights=own).astype(np.int64)
    classes = np.concatenate([_unzip(c, np.uint8) for c in rows["classes"]])[first]
    seen = total > 0
    stats = [
        np.bincount(classes[seen], minlength=CLASSES).tolist(),
        np.bincount(classes[total == 1], minlength=CLASSES).tolist(),
        np.bincount(classes, weights=total, minlength=CLASSES).astype(np.int64).tolist(),
    ]
    answers, cut = total[inverse], np.cumsum(sizes)[:-1]
    return pd.DataFrame(
        {
            "block": rows["block"],
            "n": rows["n"],
            "part": rows["part"],
            "answer": [_zip(a) for a in np.split(answers, cut)],
            "stats": [stats] + [None] * (len(rows) - 1),
        }
    )


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block.

    State 0 has no context and an arc for every word. An arc of the longest n-grams
    leads where the shorter context's arc for the same word leads, so it holds its
    weight only.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], model: dict):
        order = len(counts)
        self.width = len(block.words)
        total, distinct, texts = model["tokens"], model["distinct"], model["texts"]
        unigram = (counts[0] + 1) / (total + distinct + 1)
        prob = unigram[block.grams[0][2]]
        offsets = np.cumsum([2, *(len(c) for c in counts)])  # state 1: the beginning
        state = np.where(counts[0] > 0, offsets[0] + np.arange(len(counts[0])), 0)
        words = block.tokens[block.grams[0][1]]
        root, leads = np.zeros(self.width), np.zeros(self.width, np.int64)
        root[words], leads[words] = np.log10(unigram), state
        self.root, self.leads = root.tolist(), leads.tolist()
        fail_to, fail_weight = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1])
        #: Occurrences in training, and state, of the context before each token.
        context = np.where(block.depth > 0, np.roll(counts[0][block.grams[0][2]], 1), texts)
        after = state[block.grams[0][2]]
        before = np.where(block.depth > 0, np.roll(after, 1), 1 if texts else 0)
        self.arcs: dict[int, tuple[float, int]] = {}
        self.last: dict[int, float] = {}
        for k in range(2, order + 1):
            _, first, at, _ = block.grams[k - 1]
            has = at >= 0
            weight = model["weights"][k][block.classes[block.before]]
            known = has & (context > 0)
            count = np.where(has, counts[k - 1][at], 0)
            fail_weight[before[known]] = np.log10(weight[known])
            longer = np.where(known, (1 - weight) * count / np.maximum(context, 1) + weight * prob, prob)
            seen = counts[k - 1] > 0
            use = first[seen]
            keys = (before[use] * self.width + block.tokens[use]).tolist()
            weights = np.log10(longer[use]).tolist()
            if k == order:
                self.last = dict(zip(keys, weights))
                break
            own = np.where(seen, offsets[k - 1] + np.arange(len(seen)), 0)
            fail_to[own[seen]] = after[use]
            after = np.where(has & (count > 0), own[at], after)
            self.arcs.update(zip(keys, zip(weights, after[use].tolist())))
            inside = block.depth > 0
            context = np.where(inside & np.roll(has, 1), np.roll(count, 1), 0)
            before = np.where(inside, np.roll(after, 1), before)
            prob = longer
        self.start = 1 if texts else 0
        self.fail_to, self.fail_weight = fail_to.tolist(), fail_weight.tolist()

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text: one pass, one state."""
        last, arcs, root, leads = self.last, self.arcs, self.root, self.leads
        width, fail_to, fail_weight = self.width, self.fail_to, self.fail_weight
        state, total = self.start, 0.0
        for word in words:
            found = None
            if state:
                found = last.get(state * width + word)
                if found is not None:
                    total += found
                    state = fail_to[state]
            while state:
                arc = arcs.get(state * width + word)
                if arc is not None:
                    if found is None:
                        total += arc[0]
                    state = arc[1]
                    break
                if found is None:
                    total += fail_weight[state]
                state = fail_to[state]
            else:
                if found is None:
                    total += root[word]
                state = leads[word]
        return total


def _scorer(order: int, model: dict):
    def score(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples(index=False))
        b = Block(row, order)
        answers = answers.sort_values(["n", "part"])
        counts = [np.concatenate([_unzip(a, np.int64) for a in answers["answer"][answers["n"] == n]]) for n in range(1, order + 1)]
        automaton = Automaton(b, counts, model)
        own = counts[0][b.grams[0][2]]
        starts = np.cumsum(b.sizes) - b.sizes
        base = np.add.reduceat(np.log10((own + 1) / (model["tokens"] + model["distinct"] + 1)), starts)
        words = b.tokens.tolist()
        return pd.DataFrame(
            {
                "doc_id": pd.Series(row.doc_ids, dtype=object),
                "held_out": row.held,
                "n_tokens": b.sizes,
                "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
                "train_tokens": model["tokens"],
                "base_score": base,
                "score": [automaton.score(words[s : s + n]) for s, n in zip(starts.tolist(), b.sizes.tolist())],
            }
        )

    return score


def scored(docs: DataFrame, held: Column, order: int = 2) -> DataFrame:
    """Scores of all documents under the model of those where ``held`` is false."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held"), "text")
    shape = f"block long, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, words binary, classes binary, tokens binary, n long"
    blocks = stored(own.mapInPandas(tokenised, shape), "token-blocks")
    texts, rough = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum("n")).first()
    bits = max(0, int((rough or 0) * order // PART_KEYS)).bit_length()
    asked = blocks.mapInPandas(requests(order, bits), "n int, part int, block long, keys binary, counts binary, classes binary")
    shape = "block long, n int, part int, answer binary, stats array<array<long>>"
    answers = stored(asked.groupBy("n", "part").applyInPandas(summed, shape), "counts")
    stats = answers.where("stats IS NOT NULL").select("n", F.posexplode(F.arrays_zip(*(F.col("stats")[k].alias(c) for k, c in enumerate(("seen", "once", "all"))))))
    sums = stats.groupBy("n", "pos").agg(*(F.sum(f"col.{c}") for c in ("seen", "once", "all"))).collect()
    weights = {n: np.ones(CLASSES) for n in range(1, order + 1)}
    for n, k, _, once, every in sums:  # at most order * CLASSES rows
        weights[n][k] = min(max(once / every, 1e-6), 1.0) if every else 1.0
    model = {
        "tokens": sum(r[4] for r in sums if r[0] == 1),
        "distinct": sum(r[2] for r in sums if r[0] == 1),
        "texts": texts or 0,
        "weights": weights,
    }
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
            *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score")),
        ]
    )
    both = blocks.drop("n").groupBy("block").cogroup(answers.drop("stats").groupBy("block"))
    return both.applyInPandas(_scorer(order, model), out)
