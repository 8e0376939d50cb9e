"""Format, size and capture time from the leading structure of an image file.

Spark has no expression for this, so a small Arrow UDF walks the markers of each
JPEG or PNG. Pixels are never decoded.
"""

import struct
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.fixed_values import EXIF_DATETIME, EXIF_DATETIME_ORIGINAL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TIME_TAGS = (EXIF_DATETIME_ORIGINAL, EXIF_DATETIME)
_PNG_START = b"\x89PNG\r\n\x1a\n"
# JPEG markers that carry the frame size: all of C0..CF but DHT, JPG and DAC.
_FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# JPEG markers without a length field: TEM, RST0..RST7 and SOI.
_BARE_MARKERS = frozenset([0x01, *range(0xD0, 0xD9)])

HEADER_TYPE = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def exif_time(tiff: bytes) -> str | None:
    """Original capture time of a TIFF block, else its change time."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return None
    (entries,) = struct.unpack_from(order + "H", tiff, at)
    found = {}
    for i in range(entries):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            break
        tag, kind, size = struct.unpack_from(order + "HHI", tiff, entry)
        if tag in _TIME_TAGS and kind == 2:
            start = entry + 8
            if size > 4:
                (start,) = struct.unpack_from(order + "I", tiff, start)
            text = tiff[start : start + size].split(b"\x00")[0]
            found[tag] = text.decode("ascii", "replace").strip()
    for tag in _TIME_TAGS:
        if found.get(tag):
            return found[tag]
    return None


def _png(data: bytes):
    if data[12:16] != b"IHDR" or len(data) < 24:
        raise ValueError("PNG without a header chunk")
    width, height = struct.unpack_from(">II", data, 16)
    time = None
    at = 8
    while time is None and at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"eXIf":
            time = exif_time(data[at + 8 : at + 8 + size])
        at += 12 + size
    return "PNG", width, height, time


def _jpeg(data: bytes):
    time = None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("JPEG marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in _BARE_MARKERS:
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\x00\x00":
            time = time or exif_time(body[6:])
        if marker in _FRAME_MARKERS and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            return "JPEG", width, height, time
        if marker in (0xD9, 0xDA):
            break
        at += 2 + size
    raise ValueError("JPEG without a frame header")


def read_header(data: bytes | None):
    """(format, width, height, time) of a JPEG or PNG, or None if unreadable."""
    try:
        if data and data[:8] == _PNG_START:
            return _png(data)
        if data and data[:3] == b"\xff\xd8\xff":
            return _jpeg(data)
    except (ValueError, struct.error, IndexError):
        pass
    return None


@F.arrow_udf(HEADER_TYPE)
def image_header(content: pa.Array) -> pa.Array:
    names = ("format", "width", "height", "timestamp")
    types = (pa.string(), pa.int32(), pa.int32(), pa.string())
    rows = []
    for value in content:
        header = read_header(value.as_py())
        rows.append(None if header is None else dict(zip(names, header)))
    return pa.array(rows, type=pa.struct(list(zip(names, types))))
