"""Validation of arriving image files."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions.image_header import image_header
from spoorline.functions.text import file_name, round_exact


def _starts(content: Column, start: str) -> Column:
    return F.hex(F.substring(content, 1, len(start) // 2)) == start


def _other_format(content: Column) -> Column:
    """Name of a known format that is not accepted, by its first bytes."""
    riff = _starts(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return (
        F.when(_starts(content, "474946383761") | _starts(content, "474946383961"), "GIF")
        .when(_starts(content, "424D"), "BMP")
        .when(riff, "WEBP")
        .when(_starts(content, "49492A00") | _starts(content, "4D4D002A"), "TIFF")
    )


# First bytes of a JPEG that nearly always hold all that is asked for.
HEAD_BYTES = 1 << 16
# Segments of a JPEG looked at to learn whether they do.
HEAD_SEGMENTS = 8
# The markers of a JPEG's frame header, which holds its size.
_FRAME_MARKERS = [f"FF{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]


def _frame_in_head(content: Column) -> Column:
    """Whether a JPEG's first segments lead to its frame header within the first bytes."""

    def seen(at: Column) -> Column:
        # a one-element array binds the value, so that it is computed once a step
        return F.transform(F.array(at), lambda k: F.struct(k.alias("at"), F.hex(F.substring(content, k, F.lit(4))).alias("hex")))

    def onward(at: Column) -> Column:
        def step(s: Column) -> Column:
            size = F.conv(F.substring(s["hex"], 5, 4), 16, 10).cast("int")
            marked = s["hex"].startswith("FF") & (F.length(s["hex"]) == 8)
            return F.when(F.left(s["hex"], F.lit(4)).isin(_FRAME_MARKERS), s["at"]).when(marked, s["at"] + 2 + size)

        return F.element_at(F.transform(seen(at), step), 1)

    at = F.lit(3)
    for _ in range(HEAD_SEGMENTS):
        at = onward(at)
    frame = F.exists(seen(at), lambda s: F.left(s["hex"], F.lit(4)).isin(_FRAME_MARKERS) & (s["at"] + 9 <= HEAD_BYTES))
    return F.coalesce(frame, F.lit(False))


def _png_header(content: Column) -> Column:
    """Size of a PNG, from the fixed place of its first chunk; null if it is not there."""

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")

    whole = (F.hex(F.substring(content, 13, 4)) == "49484452") & (F.length(content) >= 24)
    return F.when(
        whole,
        F.struct(
            F.lit("PNG").alias("format"),
            number(17).alias("width"),
            number(21).alias("height"),
            F.lit(None).cast("string").alias("timestamp"),
        ),
    )


def validate_images(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Checks files with ``path``, ``length`` and ``content``; drops the bytes.

    Other columns of the files stay only if ``keep`` names them.

    A JPEG or PNG of at least 640x480 is accepted and shows its format, size,
    time and size in KB. Any other file gets a reason. Works on a stream too.
    A PNG without capture time is read by expressions; of a JPEG the first bytes travel
    to Python, and the whole file, or a PNG with a time, only if those do not do.
    """
    content = F.col("content")
    jpeg, png = _starts(content, "FFD8FF"), _starts(content, "89504E470D0A1A0A")
    timed = png & F.contains(content, F.lit(b"eXIf"))
    short = F.length(content) <= HEAD_BYTES
    looked_at = (
        F.when(jpeg & short, content)
        .when(jpeg & _frame_in_head(content), F.substring(content, 1, HEAD_BYTES))
        .when(jpeg | timed, content)
    )
    files = files.withColumn("_read", image_header(looked_at))
    header = F.when(png & ~timed, _png_header(content)).otherwise(F.col("_read"))
    checked = files.select(
        file_name("path").alias("file"),
        F.coalesce("length", F.length(content).cast("bigint")).alias("_bytes"),
        _other_format(content).alias("_other"),
        header.alias("_header"),
        *keep,
    )
    width, height = F.col("_header.width"), F.col("_header.height")
    size = F.concat(width.cast("string"), F.lit("×"), height.cast("string"))
    known = F.col("_header").isNotNull()
    small = known & ((width < fixed.MIN_WIDTH) | (height < fixed.MIN_HEIGHT))
    reason = (
        F.when(F.col("_other").isNotNull(), F.concat(F.lit("Unsupported format: "), "_other"))
        .when(~known, F.lit("Unreadable file: cannot identify image file"))
        .when(small, F.concat(F.lit("Resolution "), size, F.lit(" below minimum")))
    )
    accepted = reason.isNull()
    time = F.coalesce("_header.timestamp", F.lit(fixed.NO_TIMESTAMP))
    return checked.select(
        "file",
        accepted.alias("accepted"),
        F.when(accepted, F.col("_header.format")).alias("format"),
        F.when(accepted, size).alias("resolution"),
        F.when(accepted, time).alias("timestamp"),
        # a product, as Spark does not share the parts of what stands in a condition
        (F.when(accepted, 1.0) * round_exact(F.col("_bytes") / 1024, 1)).alias("size_kb"),
        reason.alias("reason"),
        *keep,
    )
