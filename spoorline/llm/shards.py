"""Shards of near equal bytes: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form a group that stays together. Groups lie in the order of
their text's hash; shards are runs of groups. The smallest capacity for which a greedy
left-to-right packing needs no more than the given shards is found by binary search,
and the cuts are then made within that capacity, each as near to an equal share of what
is left as the shards behind it allow.

Only sizes are ordered and summed, in Spark: rows are counted by (group, slice), where
slices of the document id divide a group of any size, and running sums are made bucket
by bucket of the hash. The search asks for the last group end at or before a position.
The driver knows the ends by cells, their first and last end only; it searches with
both bounds and has Spark divide just the cells that still matter, so what it holds is
bounded by shards x cells and the answer is exact.

Defined results: a null text has no bytes and its group is that of the empty text;
crc32 of it is 0; repeated rows each get a slot; a null doc_id comes first in its
slice; with fewer groups than shards some shards stay empty; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import stored

#: Bytes that a document costs besides its text.
OVERHEAD = 8
#: Slices of one group; each is numbered in a task of its own.
SLICES = 1 << 10
#: Buckets of the hash order in which running sums are made.
BUCKETS = 1 << 12
#: Parts into which a cell of group ends is divided at a time.
CELLS = 1 << 10


class Ends:
    """Group ends by cells: each cell has its first and last end; equal ones are exact."""

    def __init__(self, total: int, largest: int, divide: Callable[[list[tuple[int, int]]], list[tuple[int, int]]]):
        self.total, self.largest, self.divide = total, largest, divide
        self.cells = [(0, 0), *divide([(0, total)])]

    def below(self, x: int, high: bool) -> tuple[int, int | None]:
        """The last end <= x as a bound from above or below, and the cell if not exact."""
        k = bisect_right(self.cells, (x, self.total + 1)) - 1
        first, last = self.cells[k]
        if last <= x:
            return last, None
        return (min(x, last - 1) if high else first), k

    def above(self, x: int) -> tuple[int, int | None]:
        """The first end >= x, and the cell if it is only an upper bound."""
        k = bisect_left(self.cells, x, key=lambda c: c[1])
        first, last = self.cells[k]
        return (first, None) if first >= x else (last, k)

    def refine(self, wanted: set[int]) -> None:
        split = self.divide([self.cells[k] for k in sorted(wanted)])
        kept = [c for k, c in enumerate(self.cells) if k not in wanted]
        self.cells = sorted(kept + split)

    def packed(self, capacity: int, shards: int, high: bool) -> tuple[bool, set[int]]:
        """Whether a greedy packing fits, and the cells it had to guess in."""
        place, unsure = 0, set()
        for _ in range(shards):
            place, cell = self.below(place + capacity, high)
            if cell is not None:
                unsure.add(cell)
            if place >= self.total:
                break
        return place >= self.total, unsure

    def smallest(self, shards: int, high: bool) -> int:
        low, top = max(self.largest, -(-self.total // shards)), self.total
        while low < top:
            middle = (low + top) // 2
            if self.packed(middle, shards, high)[0]:
                top = middle
            else:
                low = middle + 1
        return low

    def capacity(self, shards: int) -> int:
        """The smallest capacity into which the groups can be packed."""
        while True:
            least, most = self.smallest(shards, True), self.smallest(shards, False)
            unsure = self.packed(least, shards, True)[1] | self.packed(least, shards, False)[1]
            if least == most and not unsure:
                return least
            if not unsure:
                unsure = self.packed(most, shards, False)[1] | self.packed(most - 1, shards, True)[1]
            if not unsure:
                return most
            self.refine(unsure)

    def cuts(self, shards: int) -> list[int]:
        """The end of every shard."""
        capacity = self.capacity(shards)
        while True:
            made, unsure = self._cuts(capacity, shards)
            if not unsure:
                return made
            self.refine(unsure)

    def _cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        unsure: set[int] = set()

        def exact(found: tuple[int, int | None]) -> int:
            if found[1] is not None:
                unsure.add(found[1])
            return found[0]

        least = [self.total]  # from the back: where each shard must end at the earliest
        for _ in range(shards - 1):
            least.append(exact(self.above(max(0, least[-1] - capacity))))
        least.reverse()
        made, place = [], 0
        for k in range(shards):
            aim = place + -(-(self.total - place) // (shards - k))
            low, high = exact(self.below(aim, False)), exact(self.above(min(aim, self.total)))
            best = low if low > place and aim - low <= high - aim else high
            most = exact(self.below(min(self.total, place + capacity), False))
            place = max(place, least[k], min(best, most))
            made.append(place)
        return made, unsure


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and the place of each document in the order of groups."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
    )


def ordered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows and bytes before each (group, slice) and the group's own; total, largest group."""
    spark = rows.sparkSession
    parts = rows.groupBy("grp", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = stored(parts.withColumn("bucket", F.conv(F.substring(F.hex("grp"), 1, 3), 16, 10).cast("int")), "shard-parts")
    sums = sorted(parts.groupBy("bucket").agg(F.sum("n"), F.sum("bytes")).collect())
    largest = parts.groupBy("grp").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] or 0
    before, n, size = [], 0, 0
    for bucket, own_n, own_size in sums:  # at most BUCKETS rows
        before.append((bucket, n, size))
        n, size = n + own_n, size + own_size
    offsets = F.broadcast(spark.createDataFrame(before, "bucket int, n0 long, b0 long"))
    run = Window.partitionBy("bucket").orderBy("grp", "slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("bucket").orderBy("grp").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.join(offsets, "bucket").select(
        "grp",
        "slice",
        (F.col("n0") + F.sum("n").over(run) - F.col("n")).alias("rows_before"),
        (F.col("b0") + F.sum("bytes").over(whole)).alias("group_end"),
    )
    return stored(placed, "shard-order"), size, largest


def _divider(placed: DataFrame) -> Callable:
    """Finds the first and last group end in each part of the given cells."""

    def divide(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
        inside, part = F.lit(False), F.lit(None).cast("long")
        for k, (first, last) in enumerate(cells):
            own = F.col("group_end").between(first, last)
            width = max(1, -(-(last - first + 1) // CELLS))
            inside = inside | own
            part = F.when(own, F.lit(k * 2 * CELLS) + F.floor((F.col("group_end") - first) / width)).otherwise(part)
        found = placed.where(inside).groupBy(part.alias("part")).agg(F.min("group_end"), F.max("group_end"))
        return sorted((r[1], r[2]) for r in found.collect())  # at most len(cells) * CELLS rows

    return divide


def by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """Each document's size, text_crc32, shard and slot; shards of near equal bytes."""
    rows = stored(sized(docs), "shard-sizes")
    placed, total, largest = ordered(rows)
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = Ends(total, largest, _divider(placed)).cuts(shards)
    shard = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        shard = F.when(F.col("group_end") <= cuts[k], k).otherwise(shard)
    placed = placed.withColumn("shard", shard)
    starts = dict(placed.groupBy("shard").agg(F.min("rows_before")).collect())
    start = F.lit(0).cast("long")
    for k, n in starts.items():
        start = F.when(F.col("shard") == k, F.lit(n)).otherwise(start)
    placed = placed.select("grp", "slice", "shard", (F.col("rows_before") - start).alias("slot0"))
    within = Window.partitionBy("grp", "slice").orderBy("doc_id")
    numbered = rows.withColumn("place", F.row_number().over(within))
    return numbered.join(placed, ["grp", "slice"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("place") - 1).alias("slot")
    )
