"""Image metadata from bytes, scanned pages, templates, and labels and manifests as files."""

import random
import struct

from pyspark.sql import functions as F

from vettra.operators import exif, forensics
from vettra.sources import tables


def directory(order, entries, after):
    """Bytes of a directory at an offset known to the caller: (tag, type, count, value bytes); long values go behind it."""
    head, tail = struct.pack(order + "H", len(entries)), b""
    for tag, kind, n, value in entries:
        if len(value) > 4:
            place, tail = after + len(tail), tail + value
            value = struct.pack(order + "I", place)
        head += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
    return head + b"\0" * 4 + tail


def tiff(order, software=None, saved=None, taken=None):
    text = lambda tag, v: [(tag, 2, len(v) + 1, v.encode("latin-1") + b"\0")] if v is not None else []
    entries = text(exif.SOFTWARE, software) + text(exif.MODIFIED, saved)
    size = lambda es: 2 + 12 * len(es) + 4
    link = [(exif.CAMERA, 4, 1, struct.pack(order + "I", 0))] if taken is not None else []
    first = directory(order, entries + link, 8 + size(entries + link))
    second = b""
    if taken is not None:
        at = 8 + len(first)
        first = directory(order, entries + [(exif.CAMERA, 4, 1, struct.pack(order + "I", at))], 8 + size(entries + link))
        second = directory(order, text(exif.ORIGINAL, taken), at + size([0]))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + first + second


def test_tags_of_both_byte_orders(spark):
    full = ("Adobe Photoshop 25", "2024:01:02 03:04:05", "2023:01:02 03:04:05")
    files = [tiff(o, *full) for o in "<>"] + [b"\xff\xd8\xff\xe1\x00\x10Exif\0\0" + tiff("<", *full), tiff(">", "abc"), tiff("<", None, "2024:01:02 03:04:05", None), tiff("<", "", None, "x"), b"\xff\xd8\xff\xdb no tags", b"", None, b"II*\0"]
    df = spark.createDataFrame([(i, f if f is None else bytearray(f)) for i, f in enumerate(files)], "k int, c binary")
    got = {r.k: (r.software, r.modified, r.original) for r in exif.tags(df, "k", "c").collect()}
    none = (None, None, None)
    assert got == {0: full, 1: full, 2: full, 3: ("abc", None, None), 4: (None, "2024:01:02 03:04:05", None), 5: (None, None, "x"), 6: none, 7: none, 8: none, 9: none}
    found = exif.findings(exif.tags(df, "k", "c"), "k")
    assert sorted((r.k, r.part, r.severity, r.confidence) for r in found.collect()) == [(k, p, s, c) for k in range(3) for p, s, c in ((1, "high", 0.9), (2, "low", 0.6))]


def test_damaged_bytes_have_no_tags_and_raise_nothing(spark):
    rng = random.Random(4)
    whole = tiff("<", "GIMP 2.10", "2024:01:02 03:04:05", "2023:01:02 03:04:05")
    files = [whole[:n] for n in range(len(whole))]
    for _ in range(300):
        b = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(4, len(b))] = rng.randrange(256)
        files.append(bytes(b))
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "k int, c binary")
    got = exif.tags(df, "k", "c").collect()
    assert len(got) == len(files)
    for r in got:
        if r.k < len(whole):  # cut short: a value is whole or missing
            assert r.software in (None, "GIMP 2.10") and r.modified in (None, "2024:01:02 03:04:05") and r.original in (None, "2023:01:02 03:04:05")


def test_scanned_pages_only(spark):
    pages = spark.createDataFrame([(1, 1, 10, 100.0, 200.0), (1, 2, 40, 100.0, 200.0), (2, 1, 0, 0.0, 0.0)], "doc int, page int, chars int, width double, height double")
    rows = [(1, 1, "noise", 1, 0.1, 10.0, 20.0, 30.0, 40.0), (1, 1, "ela", 2, 0.9, 25.0, 30.0, 50.0, 60.0), (1, 1, "jpeg_ghost", 3, 0.9, 90.0, 190.0, 120.0, 260.0), (1, 2, "noise", 4, 0.9, 0.0, 0.0, 9.0, 9.0), (2, 1, "ela", 5, 0.5, 1.0, 1.0, 2.0, 2.0)]
    got = forensics.deep_scan(spark.createDataFrame(rows, "doc int, page int, detector string, region int, strength double, x0 double, y0 double, x1 double, y1 double"), pages)
    title = "Tampered region on a scanned page"
    assert sorted(map(tuple, got.collect())) == [(1, 1, "high", title, 0.7, 1, 0.1, 0.1, 0.3, 0.2), (2, 1, "medium", title, 0.6, 1, None, None, None, None)]


def test_templates(spark):
    pages = spark.createDataFrame([(1, 1, 2, 0, 3), (1, 2, 1, 1, 0), (2, 2, 1, 1, 0), (2, 1, 2, 0, 3), (3, 1, 2, 0, 3)], "doc int, page int, fonts int, images int, drawings int")
    docs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, None)], "doc int, producer string")
    got = {r.doc: r.fingerprint for r in forensics.template_fingerprint(pages, docs).collect()}
    assert got[1] == got[2] != got[3] and len({*got.values()}) == 3 and all(len(v) == 32 for v in got.values())


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id": "P1", "documents": [{"filename": "a"}, {"filename": "b"}]}\n{"id": "P2", "documents": []}\n')
    assert [(r.id, r.ordinal, r.filename) for r in tables.packets(spark, str(tmp_path / "m.json"), lines=True).select("id", "ordinal", "document.filename").orderBy("ordinal").collect()] == [("P1", 0, "a"), ("P1", 1, "b")]
    (tmp_path / "l.json").write_text('{"P1": {"label": "fraud"}}\n{"P2": {"label": "clean"}}\n')
    assert {(r.packet_id, r.label.label) for r in tables.labels(spark, str(tmp_path / "l.json"), lines=True).select(F.col("packet_id"), "label").collect()} == {("P1", "fraud"), ("P2", "clean")}
