"""Byte-level BPE as a streaming transducer, and its inverse.

**Sufficient lookahead.** Merges run in rank order. Compare the runs over a text ``u``
and over ``u`` with more behind it. The two segmentations first differ at the end of
``u``, and a merge of rank r moves the first difference left by one token only: by its
left side, if that is the last common token. Its right side then starts where the
difference was, so it holds the token that moved it before on its left spine. The
longest chain of such merges with rising ranks, in bytes, bounds how far text to the
right can reach; ``lookahead`` computes it from the merge list. Tokens that end that
many bytes before the end of what was read are stable and leave the buffer, and since
no merge crosses a stable boundary, the rest of the buffer goes on by itself.

Defined results: a null text is encoded as an empty one (no ids, decoded to ``''``);
rows are independent, so repeated rows and null or repeated ids need no care; other
columns pass through whatever their names, except that the named output column is
replaced.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.text import column_function

#: Characters read at a time; a text's unfinished pretoken is all that is kept between.
SLICE = 1 << 16
#: Pretokens up to this many characters are remembered by a worker.
MEMO_CHARS = 48
#: Pretokens in one of a worker's two generations of remembered ones.
MEMO_SIZE = 150_000
#: Characters behind a pretoken that can still change where it ends.
PATTERN_REACH = 3
ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token boundary after which it cannot change any more."""
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    longest, widest = 0, 1
    for a, b in merges:
        behind, spine = 0, b
        while spine is not None:
            behind = max(behind, reach.get(spine, 0))
            spine = left.get(spine)
        here = len(a) + behind
        reach[a] = max(reach.get(a, 0), here)
        left.setdefault(a + b, a)
        longest, widest = max(longest, here), max(widest, len(a) + len(b))
    return longest + widest


class Memo(dict):
    """Ids by pretoken, in two generations so that its size stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Merges, ids and the splitting pattern of a byte-level tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        raw = lambda token: bytes(byte_of[c] for c in token)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.byte_ids = [ids[c] for c in alphabet]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.token_bytes = {i: raw(t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = lookahead([(raw(a), raw(b)) for a, b in pairs])
        #: Fixed value: the splitting pattern of byte-level BPE.
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.specials = None
        if self.special:
            longest_first = sorted(self.special, key=len, reverse=True)
            self.specials = regex.compile("|".join(map(regex.escape, longest_first)))
        self.memo = Memo(self.ids_of_piece)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of one run of bytes, by rank and then from the left."""
        if len(ids) < 2:
            return ids
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (found[0], i, ids[i], ids[i + 1], found[1])
            for i in range(n - 1)
            if (found := merge.get((ids[i], ids[i + 1])))
        ]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is part of another token by now
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if found := merge.get((new, ids[after[j]])):
                    heapq.heappush(heap, (found[0], i, new, ids[after[j]], found[1]))
            if before[i] >= 0 and (found := merge.get((ids[before[i]], new))):
                heapq.heappush(heap, (found[0], before[i], ids[before[i]], new, found[1]))
        return [i for i in ids if i >= 0]

    def ids_of_piece(self, piece: str) -> bytes:
        """Packed ids of a whole pretoken, through the window if it is long."""
        window = Window(self)
        return window.push(piece.encode()) + window.close()


class Window:
    """The bytes of one pretoken whose tokens are not stable yet."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, bytearray()
        self.limit = max(4 * vocabulary.lookahead, 1024)

    def push(self, more: bytes) -> bytes:
        out = []
        for start in range(0, len(more), self.limit):
            self.held += more[start : start + self.limit]
            if len(self.held) > self.limit:
                out.append(self._emit(len(self.held) - self.vocabulary.lookahead))
        return b"".join(out)

    def close(self) -> bytes:
        return self._emit(len(self.held))

    def _emit(self, stable: int) -> bytes:
        """Ids of the tokens that end at or before the byte ``stable``."""
        ids = self.vocabulary.merged([self.vocabulary.byte_ids[b] for b in self.held])
        size, done = 0, 0
        for k, i in enumerate(ids, 1):
            size += len(self.vocabulary.token_bytes[i])
            if size > stable:
                break
            done, kept = size, k
        if not done:
            return b""
        del self.held[:done]
        return struct.pack(f"<{kept}I", *ids[:kept])


class Encoder:
    """Reads a text in slices of any size and gives ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.rest = vocabulary, ""
        self.window: Window | None = None  # of a pretoken too long to wait for its end
        self.kind = ""

    def feed(self, text: str) -> bytes:
        return self._read(self.rest + text, final=False)

    def finish(self) -> bytes:
        return self._read(self.rest, final=True)

    def _read(self, text: str, final: bool) -> bytes:
        v, out, start = self.vocabulary, [], 0
        if v.specials:
            for found in v.specials.finditer(text):
                out.append(self._ordinary(text[start : found.start()], final=True))
                out.append(struct.pack("<I", v.special[found[0]]))
                start = found.end()
        tail = text[start:]
        hold = 0 if final else self._begun_special(tail)
        out.append(self._ordinary(tail[: len(tail) - hold], final))
        self.rest += tail[len(tail) - hold :]
        return b"".join(out)

    def _begun_special(self, text: str) -> int:
        """Characters at the end that may be the beginning of a special token."""
        sizes = (k for s in self.vocabulary.special for k in range(1, len(s)) if text.endswith(s[:k]))
        return max(sizes, default=0)

    def _ordinary(self, text: str, final: bool) -> bytes:
        """Ids of text without special tokens; what is undecided becomes ``rest``."""
        v, out, start = self.vocabulary, [], 0
        if self.window:
            head, start, over = self._inside(text, final)
            out.append(head)
            if not over:
                return b"".join(out)
        if start:
            text = text[start:]
        pieces = v.pattern.findall(text)
        self.rest = ""
        if not final:
            undecided = 0
            while pieces and undecided < PATTERN_REACH:
                undecided += len(pieces.pop())
            self.rest = text[len(text) - undecided :]
        out.append(b"".join(map(v.memo.__getitem__, pieces)))
        if len(self.rest) > SLICE:
            out.append(self._enter())
        return b"".join(out)

    def _enter(self) -> bytes:
        """Starts on the first undecided pretoken, which is long, before its end is known."""
        found = self.vocabulary.pattern.match(self.rest)
        size = found.end() - PATTERN_REACH
        if size < SLICE // 2:
            return b""
        self.window, last = Window(self.vocabulary), self.rest[found.end() - 1]
        self.kind = next(k for k in (r"\s", r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]") if regex.match(k, last))
        head, self.rest = self.rest[:size], self.rest[size:]
        return self.window.push(head.encode())

    def _inside(self, text: str, final: bool) -> tuple[bytes, int, bool]:
        """Goes on with the long pretoken: ids, characters used, and whether it ended."""
        run = regex.match(f"{self.kind}*", text).end()
        ended = run < len(text)
        if not ended and not final:
            size = max(0, run - PATTERN_REACH)
            self.rest = text[size:]
            return self.window.push(text[:size].encode()), size, False
        # white space leaves its last character to the word behind it
        size = run - 1 if ended and self.kind == r"\s" and run else run
        out = self.window.push(text[:size].encode()) + self.window.close()
        self.window, self.rest = None, ""
        return out, size, True


class Decoder:
    """Ids to text, one token at a time; holds back only an unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@functools.lru_cache(maxsize=2)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def encode_text(v: Vocabulary, text: str | None) -> bytes:
    encoder = Encoder(v)
    if text and len(text) > SLICE:
        slices = (text[k : k + SLICE] for k in range(0, len(text), SLICE))
        return b"".join(map(encoder.feed, slices)) + encoder.finish()
    encoder.rest = text or ""
    return encoder.finish()


def decode_ids(v: Vocabulary, packed: bytes | None) -> str:
    decoder, ids = Decoder(v), np.frombuffer(packed or b"", dtype="<u4")
    parts = [decoder.feed(ids[k : k + SLICE].tolist()) for k in range(0, len(ids), SLICE)]
    return "".join(parts) + decoder.finish()


def codec(spark: SparkSession, path: str):
    """``(encode, decode, round_trip)``: column functions for the tokenizer file at ``path``.

    ``encode(text)`` gives the ids as packed little-endian unsigned 32-bit integers,
    ``decode(packed)`` the text, and ``round_trip(text)`` both as (ids, text) from one
    Python worker, where two column functions in a row would each start their own.
    The file's content travels with a broadcast; its size is that of the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())

    @column_function(T.BinaryType())
    def encode(slices: Iterator[list]) -> Iterator[list]:
        v = vocabulary(shipped.value)
        for texts in slices:
            yield [encode_text(v, t) for t in texts]

    @column_function(T.StringType())
    def decode(slices: Iterator[list]) -> Iterator[list]:
        v = vocabulary(shipped.value)
        for packed in slices:
            yield [decode_ids(v, p) for p in packed]

    @column_function(ROUND_TRIP)
    def round_trip(slices: Iterator[list]) -> Iterator[list]:
        v = vocabulary(shipped.value)
        for texts in slices:
            packed = [encode_text(v, t) for t in texts]
            yield [{"ids": p, "text": decode_ids(v, p)} for p in packed]

    return encode, decode, round_trip


def token_count(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
