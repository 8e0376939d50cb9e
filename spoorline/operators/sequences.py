"""Detections of a camera as sequences in time."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import stored

#: Half an hour without a detection ends a sequence.
GAP_SECONDS = 1800

_ADDED = ("sequence_id", "position", "sequence_length", "gap_seconds", "sequence_seconds")


def camera_sequences(
    detections: DataFrame,
    gap_seconds: float = GAP_SECONDS,
    camera: str = "camera_id",
    time: str | Column = "timestamp",
    order: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Adds the sequence of each detection: its id, place, length, gap before and duration.

    A sequence ends where a camera records nothing for more than ``gap_seconds``.
    ``gap_seconds`` of a row is the time since the camera's detection before, null for its
    first; ``sequence_seconds`` is the time from the sequence's first detection to its
    last. Equal times are ordered by ``order``. A detection without a camera, or whose
    time cannot be read, belongs to no sequence: all five columns are null. Columns of
    these names are replaced.

    Rows are dealt by ranges of camera and time into pieces of equal size, so that a camera
    with most rows is cut by time. Windows stay within a piece; a row a piece carries what
    crosses its borders, the time of the last detection before and the start and size of
    the sequences that run on.
    """
    when = F.col(time) if isinstance(time, str) else time
    kept = [c for c in detections.columns if c not in _ADDED]
    moment = F.unix_micros(when.try_cast("timestamp"))
    rows = detections.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(camera).alias("camera"),
        moment.alias("at"),
        F.struct(*[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)]).alias("next"),
    )
    dated = F.col("camera").isNotNull() & F.col("at").isNotNull()
    dealt = rows.filter(dated).repartitionByRange("camera", "at", "next")
    own = stored(dealt.withColumn("piece", F.spark_partition_id()), "pieces")
    limit = round(gap_seconds * 1_000_000)
    parts = _crossing(_marked(own.select("camera", "piece", "at", "next"), own, limit))
    carry, whole = parts

    piece = ["camera", "piece"]
    marked = _marked(own, own, limit).join(carry, piece, "left")
    begun = marked.withColumn("start", F.coalesce("begun", "carried")).drop("begun", "carried")
    here = Window.partitionBy(*piece, "start")
    places = begun.withColumns(
        {
            "place": F.row_number().over(here.orderBy("at", "next")),
            "n": F.count("*").over(here),
            "end": F.max("at").over(here),
        }
    ).join(whole, [*piece, "start"], "left")
    found = places.select(
        "row.*",
        F.concat_ws("@", "camera", "start").alias("sequence_id"),
        (F.col("place") + F.coalesce("ahead", F.lit(0))).cast("long").alias("position"),
        F.coalesce("total", "n").alias("sequence_length"),
        (F.col("gap") / 1_000_000).alias("gap_seconds"),
        ((F.coalesce("last_end", "end") - F.col("start")) / 1_000_000).alias("sequence_seconds"),
    )
    nothing = {"sequence_id": "string", "position": "long", "sequence_length": "long"}
    nothing |= {"gap_seconds": "double", "sequence_seconds": "double"}
    rest = rows.filter(~dated).select(
        "row.*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    )
    return found.unionByName(rest)


def _marked(rows: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """Adds the gap before each row and the start of its sequence if that is in its piece."""
    pieces = own.groupBy("camera", "piece").agg(F.max("at").alias("reached"))
    by_camera = Window.partitionBy("camera").orderBy("piece")
    before = pieces.select("camera", "piece", F.lag("reached").over(by_camera).alias("before"))
    in_order = Window.partitionBy("camera", "piece").orderBy("at", "next")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("at") - F.coalesce(F.lag("at").over(in_order), "before")
    begins = F.coalesce(F.col("gap") > limit, F.lit(True))
    return (
        rows.join(before, ["camera", "piece"])
        .withColumn("gap", gap)
        .drop("before")
        .withColumn("begun", F.max(F.when(begins, F.col("at"))).over(so_far))
    )


def _crossing(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What crosses the borders of pieces: a start carried in, and whole sizes of sequences.

    The first table has (camera, piece, carried), the second (camera, piece, start, total,
    ahead, last_end) of the sequences that a piece begins or ends with.
    """
    piece = ["camera", "piece"]
    last = F.max("begun").over(Window.partitionBy(*piece))
    each = marked.withColumn("last", last).groupBy(*piece).agg(
        F.max("last").alias("last"),
        F.max("at").alias("reached"),
        F.count_if(F.col("begun").isNull()).alias("head"),
        F.max(F.when(F.col("begun").isNull(), F.col("at"))).alias("head_end"),
        F.count_if(F.col("begun") == F.col("last")).alias("tail"),
    )
    earlier = Window.partitionBy("camera").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    each = stored(each.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)), "borders")
    head = each.filter("head > 0").select(
        *piece, F.col("carried").alias("start"), F.col("head").alias("n"), F.col("head_end").alias("end")
    )
    tail = each.filter("tail > 0").select(
        *piece, F.col("last").alias("start"), F.col("tail").alias("n"), F.col("reached").alias("end")
    )
    same = Window.partitionBy("camera", "start")
    earlier = same.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = head.unionByName(tail).select(
        *piece,
        "start",
        F.sum("n").over(same).alias("total"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"),
        F.max("end").over(same).alias("last_end"),
    )
    return each.select(*piece, "carried"), whole


def sequence_summary(rows: DataFrame, camera: str = "camera_id", species: str = "species") -> DataFrame:
    """One row a sequence: detections, distinct labels, duration and longest gap within.

    Labels are counted in two steps, so that a long sequence is reduced where its rows are.
    """
    within = F.when(F.col("position") > 1, F.col("gap_seconds"))
    label = F.col(species).alias("label")
    some = rows.filter(F.col("sequence_id").isNotNull()).withColumn("gap", within)
    by_label = some.groupBy(F.col(camera).alias("camera_id"), "sequence_id", label).agg(
        F.count("*").alias("n"),
        F.max("sequence_seconds").alias("seconds"),
        F.max("gap").alias("gap"),
    )
    return by_label.groupBy("camera_id", "sequence_id").agg(
        F.sum("n").alias("detections"),
        F.count("label").alias("species"),
        F.max("seconds").alias("sequence_seconds"),
        F.max("gap").alias("longest_gap_seconds"),
    )
