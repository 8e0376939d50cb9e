"""Box texts and coordinates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def encode_box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Corners as ``x1,y1,x2,y2`` text."""
    return F.concat_ws(",", x1, y1, x2, y2)


def decode_box(location: str | Column) -> Column:
    """Struct of integer corners; null when the text is not a box."""
    parts = F.split(location, ",")
    corners = [F.get(parts, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(CORNERS)]
    complete = F.size(parts) == 4
    for c in corners:
        complete = complete & c.isNotNull()
    return F.when(complete, F.struct(*corners))


def to_pixels(x: Column, y: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Corners in pixels, cut toward zero, from a box given in fractions."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    return {
        "x1": (x * width).cast("int"),
        "y1": (y * height).cast("int"),
        "x2": ((x + w) * width).cast("int"),
        "y2": ((y + h) * height).cast("int"),
    }
