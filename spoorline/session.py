"""Session settings and the shared scratch folder."""

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "spoorline") -> SparkSession:
    """A local session for tests and the benchmark."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str, kept: bool = False) -> str:
    """A new folder for intermediate tables, on storage every executor can see.

    ``releasing`` deletes it with the job that made it, unless it is to be ``kept``.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting (a unit test) gets a folder of its own machine; on
    a cluster the executors would each write to their own disk, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not kept and (made := _made.get()) is not None:
        made.append(path)
    return path


_made: ContextVar[list[str] | None] = ContextVar("scratch tables of a job", default=None)


@contextmanager
def releasing(spark: SparkSession):
    """Delete the scratch tables made inside, at the end.

    For a whole job, its final write included: frames that read scratch tables do not
    outlive them.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@functools.cache
def _local_root() -> str:
    """One folder a process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="spoorline-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def stored(df: DataFrame, purpose: str, kept: bool = False) -> DataFrame:
    """The rows written to a new scratch table and read back.

    For results that several later steps read: the work runs once, and a lost
    executor costs a re-read. ``kept`` as in ``scratch_dir``.
    """
    path = scratch_dir(df.sparkSession, purpose, kept)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
