"""Running a user's own encoder or detector over image rows.

A model is given as ``make``, a function without arguments that each Python
worker calls once to load it. It ships with the task and must import what it
needs itself.
"""

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline import schemas
from spoorline.operators import detectors
from spoorline.session import stored
from spoorline.shipping import ship

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class UnreadableImage(Exception):
    """What a model raises for an image that cannot be decoded."""


class NothingReadable(RuntimeError):
    """A model read none of the images that a whole job gave it."""


def _guarded(run: Callable, rows, size: int, errors: tuple[type[Exception], ...]) -> list:
    """Results of a batch, None for each image that raises one of ``errors``.

    A batch in which an image cannot be read is run again in halves, so the readable rest
    takes a few calls. Any other exception ends the job.
    """
    try:
        return list(run(rows))
    except errors:
        if size == 1:
            return [None]
        half = size // 2
        return [*_guarded(run, rows[:half], half, errors), *_guarded(run, rows[half:], size - half, errors)]


def embed(
    df: DataFrame,
    make: Callable,
    column: str = "content",
    width: int | None = None,
    batch_size: int = 64,
    errors: tuple[type[Exception], ...] = (UnreadableImage,),
) -> DataFrame:
    """Adds ``embedding``, computed in batches by ``make()(array) -> 2-d array``.

    ``width`` is the vector length when the input column is itself a vector. A null
    input, or one for which the model raises one of ``errors``, gets a null embedding,
    the mark of an unreadable image; count these with ``unreadable``, or store the result
    with ``embed_or_fail``, which ends a job whose model could read nothing.
    """
    ship(df.sparkSession)
    encode = predict_batch_udf(
        _marking(make, errors),
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=None if width is None else [[width]],
    )
    # The batch interface takes no nulls; stand-ins are dropped again below.
    nothing = F.lit(bytearray()) if width is None else F.array_repeat(F.lit(float("nan")), width)
    given = F.col(column)
    vector = encode(F.coalesce(given, nothing.cast(df.schema[column].dataType)))
    usable = given.isNotNull() & ~F.isnan(F.get("embedding", F.lit(0)))
    return df.withColumn("embedding", vector).withColumn(
        "embedding", F.when(usable, F.col("embedding"))
    )


def _marking(make: Callable, errors: tuple[type[Exception], ...]) -> Callable:
    """A model that answers NaN for each image it cannot decode, and for a stand-in."""

    def load():
        model = make()

        def empty(row) -> bool:
            if isinstance(row, np.ndarray):
                return bool(np.isnan(row).all())
            return len(row) == 0

        def predict(batch):
            real = [i for i in range(len(batch)) if not empty(batch[i])]
            found = _guarded(model, batch[real], len(real), errors) if real else []
            known = [np.asarray(v, dtype=np.float32) for v in found if v is not None]
            length = len(known[0]) if known else 1
            out = np.full((len(batch), length), np.nan, dtype=np.float32)
            for i, v in zip(real, found):
                if v is not None:
                    out[i] = v
            return out

        return predict

    return load


def unreadable(embedded: DataFrame, column: str = "content") -> DataFrame:
    """How many images were given, had no content, and could not be read."""
    given = F.col(column).isNotNull()
    return embedded.agg(
        F.count("*").alias("images"),
        F.count_if(~given).alias("without_content"),
        F.count_if(given & F.col("embedding").isNull()).alias("unreadable"),
    )


def _verdict(counted: DataFrame, watch: Observation, purpose: str) -> DataFrame:
    """The rows, stored; an error if ``watch`` saw failed images and none that was read.

    Images are counted while they are written, so the verdict falls on the totals of the
    job and does not depend on batches or partitions.
    """
    done = stored(counted, purpose)
    found = watch.get
    if found["failed"] and not found["read"]:
        raise NothingReadable(f"the model read none of {found['failed']} images")
    return done


def embed_or_fail(df: DataFrame, make: Callable, column: str = "content", **options) -> DataFrame:
    """``embed``, stored without the input column; an error if no image could be read."""
    watch, vector = Observation(), F.col("embedding")
    given = F.col(column).isNotNull()
    read, failed = F.count_if(given & vector.isNotNull()), F.count_if(given & vector.isNull())
    counted = embed(df, make, column, **options).observe(watch, read.alias("read"), failed.alias("failed"))
    return _verdict(counted if column == "embedding" else counted.drop(column), watch, "embedded")


DETECTED = T.StructType(
    schemas.RAW_BOXES.fields + [T.StructField("backend", T.StringType())]
)


def detect_boxes(
    df: DataFrame,
    make: Callable,
    column: str = "content",
    batch_size: int = 64,
    errors: tuple[type[Exception], ...] = (UnreadableImage,),
    show_unreadable: bool = False,
) -> DataFrame:
    """Raw boxes of each image, numbered from 0 in the order the model gives them.

    ``make()`` returns a detector and the name of its backend. The detector takes a list
    of images and returns, for each, rows of (class_id, conf, x1, y1, x2, y2). An image
    without content, or for which the detector raises one of ``errors``, has no boxes;
    with ``show_unreadable`` the latter give one row without a box.
    """
    rows = _detected(df, make, column, batch_size, errors)
    return _shown(rows, show_unreadable)


def detect_or_fail(
    df: DataFrame, make: Callable, column: str = "content", show_unreadable: bool = False, **options
) -> DataFrame:
    """``detect_boxes``, stored; an error if no image could be read."""
    watch, outcome = Observation(), F.col("outcome")
    # an image that was read has a first box, or a row that tells of none
    read = F.count_if((F.col("box_id") == 0) | (outcome == "empty"))
    rows = _detected(df, make, column, **options)
    counted = rows.observe(watch, read.alias("read"), F.count_if(outcome == "unreadable").alias("failed"))
    return _shown(_verdict(counted, watch, "detected"), show_unreadable)


def _shown(rows: DataFrame, show_unreadable: bool) -> DataFrame:
    kept = ["box", "unreadable"] if show_unreadable else ["box"]
    return rows.filter(F.col("outcome").isin(kept)).drop("outcome")


def _detected(
    df: DataFrame,
    make: Callable,
    column: str = "content",
    batch_size: int = 64,
    errors: tuple[type[Exception], ...] = (UnreadableImage,),
) -> DataFrame:
    """Boxes, and a row for each image that has none or could not be read."""
    ship(df.sparkSession)
    names = [*DETECTED.fieldNames(), "outcome"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector, backend = make()
        for batch in batches:
            for k in range(0, len(batch), batch_size):
                part = batch[k : k + batch_size]
                contents = part[column].tolist()
                found = _guarded(detector, contents, len(contents), errors)
                rows = []
                for image_id, boxes in zip(part["image_id"], found):
                    if boxes:
                        rows += [(image_id, i, *box, backend, "box") for i, box in enumerate(boxes)]
                    else:
                        outcome = "unreadable" if boxes is None else "empty"
                        rows.append((image_id, *[None] * (len(names) - 3), backend, outcome))
                yield pd.DataFrame(rows, columns=names)

    readable = df.select("image_id", column).filter(F.col(column).isNotNull())
    return readable.mapInPandas(run, T.StructType([*DETECTED.fields, T.StructField("outcome", T.StringType())]))


def first_loadable(
    *backends: tuple[str, Callable], missing: tuple[type[Exception], ...] = (ImportError,)
) -> Callable:
    """A ``make`` that tries named model loaders in turn and tells which one held.

    Only ``missing`` means that a backend is not installed; a loader that fails in any
    other way ends the job. Each worker chooses for itself: where executors may differ,
    use ``agreed``.
    """

    def make():
        problems = []
        for name, load in backends:
            try:
                return load(), name
            except missing as problem:
                problems.append(f"{name}: {problem}")
        raise RuntimeError("no backend could be loaded; " + "; ".join(problems))

    return make


def pinned(name: str, load: Callable) -> Callable:
    """A ``make`` of one backend, which fails where that cannot be loaded."""

    def make():
        return load(), name

    return make


PROBE = "backend string, loads boolean, problem string"


def agreed(
    spark: SparkSession,
    *backends: tuple[str, Callable],
    missing: tuple[type[Exception], ...] = (ImportError,),
    tasks: int | None = None,
) -> Callable:
    """A ``make`` of the first backend that loads wherever it is tried, the same for a whole job.

    A barrier stage of as many tasks as run at once (``tasks``) tries every loader at the
    same time, so that no executor is passed over; with dynamic allocation, which has no
    barrier stages, plain tasks do. An executor that joins later and lacks the backend
    ends the job: one result never mixes detectors.
    """
    ship(spark)
    count = tasks or spark.sparkContext.defaultParallelism
    dynamic = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, load in backends if len(batch) else ():
                try:
                    load()
                    rows.append((name, True, None))
                except missing as problem:
                    rows.append((name, False, str(problem)))
            yield pd.DataFrame(rows, columns=["backend", "loads", "problem"])

    tried = spark.range(0, count, 1, count).mapInPandas(probe, PROBE, barrier=not dynamic)
    # one row a backend
    found = tried.groupBy("backend").agg(F.bool_and("loads").alias("loads"), F.max("problem").alias("problem"))
    by_name = {r.backend: r for r in found.collect()}
    for name, load in backends:
        if by_name[name].loads:
            return pinned(name, load)
    raise RuntimeError("no backend loads everywhere; " + "; ".join(f"{n}: {by_name[n].problem}" for n, _ in backends))


@dataclass(frozen=True)
class Pipeline:
    """What a named pipeline keeps of its detector's raw output, and how."""

    kind: str
    keep: Callable[[DataFrame], DataFrame]

    def localise(self, images: DataFrame, raw: DataFrame) -> DataFrame:
        return detectors.localise(images, self.keep(raw), self.kind)


class _AnimalBoxPipeline(Pipeline):
    def localise(self, images: DataFrame, raw: DataFrame) -> DataFrame:
        return detectors.localise_animals(images, raw)


def _counted_boxes(raw: DataFrame) -> DataFrame:
    """Animal boxes of the counting detector, or of its class-id fallback."""
    if "category" in raw.columns:
        return detectors.category_boxes(raw, F.col("width"), F.col("height"))
    return detectors.class_boxes(raw)


REGISTRY: dict[str, Pipeline] = {
    "bioclip_sam": Pipeline("mask", detectors.mask_instances),
    "bioclip_yolo": _AnimalBoxPipeline("bbox", detectors.animal_boxes),
    "bioclip_megadetector": Pipeline("bbox", _counted_boxes),
}


def pipeline(name: str) -> Pipeline:
    """A registered pipeline by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown pipeline {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]
