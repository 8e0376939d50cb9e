"""Sends this package to the executors, which need it to run a user's model or column functions."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from spoorline.session import scratch_dir


def ship(spark: SparkSession) -> None:
    """Put the package's sources into the shared folder and name them to Spark, once a session.

    Spark's workers then find the package whether or not it is installed where they run.
    """
    context = spark.sparkContext
    if getattr(context, "_spoorline_shipped", False):
        return
    package, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    path = scratch_dir(spark, "spoorline-sources", kept=True) + ".zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path)
    context._spoorline_shipped = True
