"""Sources and sinks: Parquet tables, packet manifests, labels, registries, append and additive migration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.functions import fixed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(packet_id, created_at, submitted_at, ordinal, document) of manifests, one JSON object a file (or a line)."""
    raw = spark.read.option("multiLine", not lines).json(path)
    head = [F.col(c) for c in ("id", "created_at", "submitted_at") if c in raw.columns]
    return raw.select(*head, F.posexplode("documents").alias("ordinal", "document"))


def existing_documents(documents: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Documents whose file is there."""
    return documents.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(packet_id, label struct) of one JSON object keyed by packet id (or of one a line)."""
    value = "map<string, struct<label: string, fraud_types: array<string>, reasons: array<string>, affected_docs: array<string>>>"
    return spark.read.option("wholetext", not lines).text(path).select(F.explode(F.from_json("value", value)).alias("packet_id", "label"))


def verify(keys: DataFrame, registry: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Registry look-up by left join: found, and the status, ``active`` by default and ``not_found`` otherwise."""
    known = registry.withColumn("__hit", F.lit(True))
    found = F.col("__hit").isNotNull()
    state = F.when(found, F.coalesce(F.col(status), F.lit("active"))).otherwise("not_found")
    return keys.join(known, key, "left").withColumn("found", found).withColumn("verified_status", state).drop("__hit")


#: Registries by name: their key, the column that a lookup gives, and what stands for a missing record.
ADAPTERS: dict[str, tuple[str, Callable[[], Column], Callable[[], Column] | None]] = {
    "ais": ("pan", lambda: F.col("reported_income"), None),
    "cersai": ("pan", lambda: F.col("charges"), None),
    "digilocker": ("pan", lambda: F.col("documents"), None),
    "gstin": ("gstin", lambda: F.col("legal_name"), None),
    "mca21": ("cin", lambda: F.lower("status") == "active", lambda: F.lit(False)),
    "property_registry": ("property_id", lambda: F.col("registered_market_value").cast("double"), None),
}


def look_up(rows: DataFrame, key: str, registry: DataFrame, service: str, name: str) -> DataFrame:
    """rows with the registry's answer as column `name`: lists are empty, flags false and values null for unknown keys."""
    of, answer, missing = ADAPTERS[service]
    known = registry.select(F.col(of).alias("__key"), answer().alias(name))
    kind = known.schema[name].dataType
    out = rows.join(known, F.col(key) == F.col("__key"), "left").drop("__key")
    if isinstance(kind, T.ArrayType):
        return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out if missing is None else out.withColumn(name, F.coalesce(name, missing()))


def available_keys(registry: DataFrame, service: str) -> DataFrame:
    return registry.select(F.col(ADAPTERS[service][0]).alias("key")).distinct()


def charges_on(registry: DataFrame, pan: str, charges: str, property_id: Column) -> DataFrame:
    """Registered charges on a property: unnest, then filter."""
    return registry.select(pan, F.inline(charges)).where(F.col("property_id") == property_id)


def text_source(pages: DataFrame, doc: str, page_no: str, text: str, at_least: int = 15) -> DataFrame:
    """(doc, text, n_pages, source): page texts joined in order; a page with fewer visible characters counts as scanned."""
    embedded = F.length(F.trim(F.coalesce(text, F.lit("")))) >= at_least
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("n"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"), F.bool_and(embedded).alias("every"), F.bool_or(embedded).alias("some"))
    source = F.when(F.col("every"), "embedded").when(F.col("some"), "mixed").otherwise("ocr")
    return rows.select(doc, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"), F.size("p").alias("n_pages"), source.alias("source"))


def text_or_ocr(pages: DataFrame, ocr: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """(doc, text, source): the embedded text of all pages if any page has more than 10 visible characters, else the whole document's recognised text.

    ocr: (doc, ocr_text).
    """
    own = F.coalesce(text, F.lit(""))
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("n"), own.alias("t")))).alias("p"), (F.max(F.length(F.trim(own))) > fixed.DOCUMENT_TEXT).alias("layer"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    return rows.join(ocr.select(doc, "ocr_text"), doc, "left").select(doc, F.when(F.col("layer"), joined).otherwise(F.coalesce("ocr_text", F.lit(""))).alias("text"), F.when(F.col("layer"), "embedded").otherwise("ocr").alias("source"))


def load_files(files: DataFrame, pages: DataFrame, doc: str, at_least: int = fixed.PAGE_TEXT) -> DataFrame:
    """(doc, kind, text, n_pages, source, ocr_used, needs_password, ok) of files of any kind; nothing raises.

    files: (doc, path, locked). pages: (doc, page_no, text, ocr_text); an image has one page. A page with less than
    `at_least` visible characters takes its recognised text. Locked files have no text; files without any text are not ok.
    """
    image = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*fixed.IMAGE_EXTENSIONS)
    own, seen = F.coalesce("text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    layer = (F.length(F.trim(own)) >= at_least) & ~F.col("image")
    typed = files.select(doc, image.alias("image"), F.coalesce("locked", F.lit(False)).alias("locked")).join(pages, doc, "left")
    page = F.when(F.col("page_no").isNotNull() & ~F.col("locked"), F.struct(F.col("page_no").alias("n"), F.when(layer, own).otherwise(seen).alias("t"), layer.alias("layer")))
    rows = typed.groupBy(doc).agg(F.first("image").alias("image"), F.first("locked").alias("locked"), F.array_sort(F.collect_list(page)).alias("p"))
    every, some = F.forall("p", lambda x: x["layer"]), F.exists("p", lambda x: x["layer"])
    source = F.when(F.col("image"), "image-ocr").when(F.size("p") == 0, None).when(every, "embedded").when(some, "mixed").otherwise("ocr")
    out = rows.select(
        doc, F.when(F.col("image"), "image").otherwise("pdf").alias("kind"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"), F.size("p").alias("n_pages"), source.alias("source"),
        (F.col("image") | F.exists("p", lambda x: ~x["layer"] & x["t"].rlike(r"\S"))).alias("ocr_used"), (F.col("locked") & ~F.col("image")).alias("needs_password"),
    )
    return out.withColumn("ok", ~F.col("needs_password") & F.col("text").rlike(r"\S"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def load_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose later parts may have more columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A persisted edge table, or an empty one where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: columns that a table lacks, as nulls."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns))
