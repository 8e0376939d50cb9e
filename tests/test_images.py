import os
import struct
from datetime import datetime, timedelta, timezone

import pytest

from spoorline.functions.image_header import read_header
from spoorline.operators.aggregates import validation_summary
from spoorline.operators.images import validate_images
from spoorline.streaming import ingest


def png(width, height, time=None):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"

    exif = chunk(b"eXIf", tiff({306: time})) if time else b""
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", b"x" * 40) + exif


def tiff(tags, order="<"):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    body, data, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, text in tags.items():
        value = text.encode() + b"\0"
        body += struct.pack(order + "HHII", tag, 2, len(value), at + len(data))
        data += value
    start = mark + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags))
    return start + body + b"\0" * 4 + data


def jpeg(width, height, exif=None, filler=0):
    def segment(marker, body):
        return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9)
    if exif:
        out += segment(0xE1, b"Exif\0\0" + exif)
    out += segment(0xE2, b"i" * filler) * (2 if filler else 0)
    out += segment(0xC4, b"\0" * 20)
    out += segment(0xC2, b"\x08" + struct.pack(">HH", height, width) + b"\x03" + b"\0" * 9)
    return out + segment(0xDA, b"\0" * 10) + b"data\xff\xd9"


TIME = "2010:07:20 06:14:06"
OLDER = "2009:01:01 00:00:00"


@pytest.mark.parametrize(
    "data, header",
    [
        (png(640, 480), ("PNG", 640, 480, None)),
        (png(1, 2, TIME), ("PNG", 1, 2, TIME)),
        (jpeg(1920, 1080), ("JPEG", 1920, 1080, None)),
        (jpeg(10, 20, tiff({306: TIME})), ("JPEG", 10, 20, TIME)),
        (jpeg(10, 20, tiff({306: OLDER, 36867: TIME}, ">")), ("JPEG", 10, 20, TIME)),
        (jpeg(10, 20, tiff({271: "maker"})), ("JPEG", 10, 20, None)),
        (jpeg(7, 9, tiff({306: TIME}), filler=60000), ("JPEG", 7, 9, TIME)),
        (jpeg(10, 20)[:30], None),
        (b"\xff\xd8\xff", None),
        (png(10, 10)[:12], None),
        (b"", None),
        (None, None),
        (b"GIF89a", None),
    ],
)
def test_headers(data, header):
    assert read_header(data) == header


FILES = {
    "exact.png": png(640, 480),
    "narrow.png": png(639, 480),
    "low.jpg": jpeg(640, 479),
    "timed.jpg": jpeg(1920, 1080, tiff({306: TIME})),
    "plain.jpg": jpeg(1920, 1080),
    "anim.gif": b"GIF89a" + b"\0" * 20,
    "scan.tif": b"II*\0" + b"\0" * 20,
    "new.webp": b"RIFF\x10\0\0\0WEBPVP8 ",
    "old.bmp": b"BM" + b"\0" * 30,
    "junk.jpg": b"this is not an image",
    "cut.jpg": jpeg(1920, 1080)[:10],
    "empty.jpg": b"",
}
REASONS = {
    "narrow.png": "Resolution 639×480 below minimum",
    "low.jpg": "Resolution 640×479 below minimum",
    "anim.gif": "Unsupported format: GIF",
    "scan.tif": "Unsupported format: TIFF",
    "new.webp": "Unsupported format: WEBP",
    "old.bmp": "Unsupported format: BMP",
    "junk.jpg": "Unreadable file: cannot identify image file",
    "cut.jpg": "Unreadable file: cannot identify image file",
    "empty.jpg": "Unreadable file: cannot identify image file",
}


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "arriving"
    place.mkdir()
    for name, data in FILES.items():
        (place / name).write_bytes(data)
    return str(place)


# Spark's file sources pass over files without bytes.
READ = [name for name, data in FILES.items() if data]


def test_headers_behind_the_first_bytes_are_found(spark):
    """JPEGs whose size, or capture time, lies behind what is sent at first; a PNG with a time."""
    filler = b"\xff\xe2" + (60_000).to_bytes(2, "big") + b"x" * 59_998
    late = jpeg(1920, 1080, tiff({306: TIME}))
    rows = [("late.jpg", late[:2] + filler * 3 + late[2:]), ("plain.png", png(800, 600))]
    rows.append(("junk.jpg", b"\xff\xd8\xff" + b"\0" * 200_000))
    files = spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in rows], "path string, length long, content binary")
    got = {r.file: (r.accepted, r.resolution, r.timestamp) for r in validate_images(files).collect()}
    assert got["late.jpg"] == (True, "1920×1080", TIME)
    assert got["plain.png"] == (True, "800×600", "not in EXIF") and not got["junk.jpg"][0]


def test_validation(spark):
    files = spark.createDataFrame(
        [(f"/in/{name}", len(data), bytearray(data)) for name, data in FILES.items()],
        "path string, length long, content binary",
    )
    got = {r.file: r for r in validate_images(files).collect()}
    assert set(got) == set(FILES)
    assert {n: r.reason for n, r in got.items() if not r.accepted} == REASONS
    timed = got["timed.jpg"]
    assert (timed.format, timed.resolution, timed.timestamp) == ("JPEG", "1920×1080", TIME)
    assert timed.size_kb == round(len(FILES["timed.jpg"]) / 1024, 1)
    assert got["exact.png"].timestamp == "not in EXIF"
    summary = validation_summary(validate_images(files)).first()
    assert (summary.received, summary.accepted, summary.rejected, summary.no_timestamp) == (
        12, 3, 9, 2)
    none = validation_summary(validate_images(files.limit(0))).first()
    assert tuple(none) == (0, 0, 0, 0)


def test_stream_equals_batch_and_counts_files_once(spark, folder, tmp_path, rows):
    output, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    files = ingest.image_file_stream(spark, folder, files_per_batch=5)
    ingest.ingest_stream(files, output, checkpoint).awaitTermination()
    batch = validate_images(spark.read.format("binaryFile").load(folder))
    columns = batch.columns
    stored = ingest.read_ingested(spark, output)
    assert rows(stored, *columns) == rows(batch, *columns)
    assert {r.file for r in stored.collect()} == set(READ)
    assert ingest.read_ingested(spark, output, accepted=True).count() == 3
    # A later run takes only what is new.
    (tmp_path / "arriving" / "late.png").write_bytes(png(800, 600))
    again = ingest.image_file_stream(spark, folder, files_per_batch=5)
    ingest.ingest_stream(again, output, checkpoint).awaitTermination()
    assert ingest.read_ingested(spark, output).count() == len(READ) + 1


@pytest.fixture
def uploads(spark, tmp_path):
    """Adds batches of uploads, a file of rows (name, bytes, seconds) each, and streams them."""
    place = tmp_path / "uploads"
    place.mkdir()
    count = []

    def add(*rows):
        start = datetime(2024, 1, 1, tzinfo=timezone.utc)
        data = [(f"in/{n}", len(d), bytearray(d), start + timedelta(seconds=s)) for n, d, s in rows]
        frame = spark.createDataFrame(data, "path string, length long, content binary, sent timestamp")
        frame.coalesce(1).write.mode("append").parquet(str(place))
        newest = max((f for f in place.glob("*.parquet") if f not in count), key=lambda f: f.stat().st_mtime)
        count.append(newest)
        os.utime(newest, (1_700_000_000 + len(count), 1_700_000_000 + len(count)))

    def stream():
        schema = "path string, length long, content binary, sent timestamp"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place))

    return add, stream


def places(tmp_path):
    return [str(tmp_path / name) for name in ("accepted", "rejected", "checkpoint")]


def test_two_tables_of_first_uploads(spark, uploads, tmp_path, rows):
    add, stream = uploads
    good, other, bad = png(800, 600), png(900, 700), png(10, 10)
    add(("a.png", good, 0), ("a.png", good, 1), ("b.png", bad, 2), ("c.png", good, 3))
    add(("a.png", good, 50), ("a.png", other, 51), ("b.png", bad, 52), ("d.gif", b"GIF89a..", 53))
    accepted, rejected, checkpoint = places(tmp_path)
    ingest.ingest_tables(stream(), accepted, rejected, checkpoint, "60 seconds", "sent").awaitTermination()
    assert rows(ingest.read_accepted(spark, accepted), "file", "resolution", "batch") == [
        ("a.png", "800×600", 0), ("a.png", "900×700", 1), ("c.png", "800×600", 0)]
    assert rows(ingest.read_rejected(spark, rejected), "file", "batch") == [("b.png", 0), ("d.gif", 1)]
    # a file that comes again long after its first upload is a new one
    add(("x.png", good, 500))
    ingest.ingest_tables(stream(), accepted, rejected, checkpoint, "60 seconds", "sent").awaitTermination()
    add(("a.png", good, 520), ("x.png", good, 521))
    ingest.ingest_tables(stream(), accepted, rejected, checkpoint, "60 seconds", "sent").awaitTermination()
    found = rows(ingest.read_accepted(spark, accepted), "file", "resolution")
    assert found == [("a.png", "800×600"), ("a.png", "800×600"), ("a.png", "900×700"), ("c.png", "800×600"), ("x.png", "800×600")]


def test_a_batch_run_again_leaves_each_row_once(spark, uploads, tmp_path, rows, monkeypatch):
    add, stream = uploads
    add(("a.png", png(800, 600), 0), ("b.png", png(10, 10), 1))
    accepted, rejected, checkpoint = places(tmp_path)
    write, calls = ingest.write_batch, []

    def failing(frame, path, number):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("killed between the two writes")
        write(frame, path, number)

    monkeypatch.setattr(ingest, "write_batch", failing)
    with pytest.raises(Exception, match="killed between"):
        ingest.ingest_tables(stream(), accepted, rejected, checkpoint, arrived="sent").awaitTermination()
    assert ingest.read_accepted(spark, accepted).count() == 1 and ingest.read_rejected(spark, rejected).count() == 0
    ingest.ingest_tables(stream(), accepted, rejected, checkpoint, arrived="sent").awaitTermination()
    assert calls[2:4] == [accepted, rejected]
    assert rows(ingest.read_accepted(spark, accepted), "file") == [("a.png",)]
    assert rows(ingest.read_rejected(spark, rejected), "file") == [("b.png",)]


def test_files_without_a_time_arrive_with_their_batch(spark, folder, tmp_path):
    accepted, rejected, checkpoint = places(tmp_path)
    files = ingest.image_file_stream(spark, folder, files_per_batch=5)
    ingest.ingest_tables(files, accepted, rejected, checkpoint).awaitTermination()
    found = {r.file for r in ingest.read_accepted(spark, accepted).collect()}
    reasons = {r.file: r.reason for r in ingest.read_rejected(spark, rejected).collect()}
    assert found | set(reasons) == set(READ) and not found & set(reasons)
    assert reasons == {n: r for n, r in REASONS.items() if n in READ}
