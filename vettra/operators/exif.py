"""Tags of binary TIFF directories (bare, or inside a JPEG) by column expressions, and what they say of an image.

Numbers have the byte order that the header names. Directories, values and the link to the
camera's directory are followed by their offsets; what leaves the bytes, overflows or has
another type is no tag, so malformed bytes have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed

# fixed values: tag numbers and the types of their values
SOFTWARE, MODIFIED, CAMERA, ORIGINAL = 0x0131, 0x0132, 0x8769, 0x9003
ASCII, LONG = 2, 4
#: Tags that a directory may have; more means that the bytes are no directory.
MOST_TAGS = 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def number(data: Column, little: Column, at: Column, size: int) -> Column:
    """The unsigned number of 2 or 4 bytes at an offset of hexadecimal data; null beyond its end."""
    order = lambda raw: F.when(little, F.concat(*(F.substr(raw, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))))).otherwise(raw)
    read = lambda a: F.when((a >= 0) & (2 * (a + size) <= F.length(data)), F.conv(bound(F.substr(data, (2 * a + 1).cast("int"), F.lit(2 * size)), order), 16, 10).cast("long"))
    return bound(at, read)


def directory(data: Column, little: Column, at: Column) -> Column:
    """(tag, type, count, place of the value) of each entry; null where there is no whole directory."""
    entry = lambda e: F.struct(number(data, little, e, 2).alias("tag"), number(data, little, e + 2, 2).alias("type"), number(data, little, e + 4, 4).alias("n"), (e + 8).alias("at"))
    places = lambda a, n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: entry(a + 2 + 12 * i))
    whole = lambda a, n: (n > 0) & (n <= MOST_TAGS) & (2 * (a + 2 + 12 * n) <= F.length(data))
    return bound(at, lambda a: bound(number(data, little, a, 2), lambda n: F.when(whole(a, n), places(a, n))))


def text(data: Column, little: Column, entry: Column) -> Column:
    """The value of a text entry, up to its first zero byte; null for other types and places beyond the end."""

    def value(e: Column) -> Column:
        cut = lambda at: F.when((e["type"] == ASCII) & (e["n"] > 0) & (2 * (at + e["n"]) <= F.length(data)), F.substr(data, (2 * at + 1).cast("int"), (2 * e["n"]).cast("int")))
        return bound(F.when(e["n"] <= 4, e["at"]).otherwise(number(data, little, e["at"], 4)), cut)

    return F.nullif(F.trim(F.regexp_replace(F.decode(F.unhex(bound(entry, value)), "ISO-8859-1"), "(?s)\\x00.*", "")), F.lit(""))


def tagged(entries: Column, tag: int) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(1))


def tags(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, software, modified, original) of binary files; a JPEG's tags follow its ``Exif`` mark. Nulls where there is no tag."""
    h = files.select(key, F.hex(content).alias("h"))
    mark = F.instr("h", "457869660000")  # 'Exif' and two zero bytes
    inside = F.when((mark > 0) & (mark % 2 == 1), F.substr("h", (mark + 12).cast("int")))
    d = h.select(key, F.when(F.startswith("h", F.lit("FFD8")), inside).otherwise(F.col("h")).alias("d"))
    little = F.when(F.startswith("d", F.lit("49492A00")), True).when(F.startswith("d", F.lit("4D4D002A")), False)
    d = d.withColumn("little", little).withColumn("d", F.when(F.col("little").isNotNull(), F.col("d")))
    data, little = F.col("d"), F.col("little")
    d = d.withColumn("first", directory(data, little, number(data, little, F.lit(4).cast("long"), 4)))
    link = bound(tagged(F.col("first"), CAMERA), lambda e: F.when(e["type"] == LONG, number(data, little, e["at"], 4)))
    d = d.withColumn("camera", directory(data, little, link))
    of = lambda entries, tag: text(data, little, tagged(F.col(entries), tag))
    return d.select(key, of("first", SOFTWARE).alias("software"), of("first", MODIFIED).alias("modified"), F.coalesce(of("first", ORIGINAL), of("camera", ORIGINAL)).alias("original"))


def findings(tagged_files: DataFrame, key: str) -> DataFrame:
    """(key, part, severity, title, confidence, value): editors among the software, and images saved again after they were taken."""
    low = F.lower(F.coalesce("software", F.lit("")))
    editor = F.greatest(*(low.contains(w) for w in fixed.EDITOR_SOFTWARE))
    row = lambda part, hit, severity, title, confidence, value: F.when(hit, F.struct(F.lit(part).alias("part"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(confidence).alias("confidence"), value.alias("value")))
    signs = F.array(
        row(1, editor, "high", "Image-editor software in metadata", 0.9, F.col("software")),
        row(2, F.col("modified") != F.col("original"), "low", "Modified after capture (EXIF)", 0.6, F.concat_ws(" / ", "modified", "original")),
    )
    return tagged_files.select(key, F.explode(F.array_compact(signs)).alias("s")).select(key, "s.*")
