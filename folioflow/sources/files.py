"""File listings, sidecars and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.cleaning import collapse
from folioflow.functions.entities import unescaped_html
from folioflow.functions.formats import content_id

KINDS = ("epub", "pdf")
SIDECAR = "sayfa int, dosya string, sure_ms bigint, zamanlar array<array<bigint>>, uretim_sn double"


def book_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of a folder: see ``dispatch``."""
    return dispatch(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def dispatch(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of files (path, content): files (path, kind, book_id, content) have a suffix that is read, in any case."""
    suffix = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1))
    kind = F.coalesce(F.nullif(suffix, F.lit("")), F.lit("none"))
    sorted_ = found.withColumn("kind", kind)
    files = sorted_.where(F.col("kind").isin(*KINDS)).select("path", "kind", content_id(F.col("content")).alias("book_id"), "content")
    refused = sorted_.where(~F.col("kind").isin(*KINDS))
    return files, rejects(refused, "dispatch", F.lit("suffix"), F.col("kind"))


def rejects(rows: DataFrame, stage: str, reason: Column, detail: Column) -> DataFrame:
    """Rows that a source refuses, in the one shape that all sources share: (path, stage, reason, detail)."""
    return rows.select("path", F.lit(stage).alias("stage"), reason.alias("reason"), F.left(detail.cast("string"), F.lit(200)).alias("detail"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, mtime) of files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def chapter_files(listed: DataFrame) -> DataFrame:
    """``listed`` with chapter, from the number that leads the name."""
    return listed.withColumn("chapter", F.left("name", F.lit(3)).try_cast("int") - 1)


def sidecars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the page records below a folder: see ``parse_sidecars``. Spark's scans pass over files of no bytes, so these are in neither."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parse_sidecars(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_sidecars(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON texts (path, value): records (path, page_no, file, duration_ms, spans, synth_s).

    A record counts only with a duration. Refused are texts that are no JSON, fields of another type, and records without a duration.
    """
    kept = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    read = raw.withColumn("r", F.from_json("value", f"{SIDECAR}, broken string", kept))
    reason = F.when(F.try_parse_json("value").isNull(), "not json").when(F.col("r.broken").isNotNull(), "type").when(F.col("r.sure_ms").isNull(), "no duration")
    judged = read.withColumn("reason", reason)
    span = F.transform("r.zamanlar", lambda z: F.struct(F.get(z, F.lit(0)).alias("start_ms"), F.get(z, F.lit(1)).alias("end_ms")))
    good = judged.where("reason is null").select("path", F.col("r.sayfa").alias("page_no"), F.col("r.dosya").alias("file"), F.col("r.sure_ms").alias("duration_ms"), span.alias("spans"), F.col("r.uretim_sn").alias("synth_s"))
    return good, rejects(judged.where("reason is not null"), "sidecar", F.col("reason"), F.col("value"))


def settings(text: DataFrame, col: str = "value") -> DataFrame:
    """Settings of JSON texts; a broken or missing one gives nulls."""
    return text.select(F.from_json(col, "genel_adres string, kullanici string").alias("s")).select(F.col("s.genel_adres").alias("base"), F.col("s.kullanici").alias("owner"))


def voices(listed: DataFrame) -> DataFrame:
    """Voice names of model files, sorted."""
    return listed.select(F.regexp_extract("name", r"^tr_TR-(.*)-medium\.onnx$", 1).alias("voice")).where("voice <> ''").orderBy("voice")


def corpus_paragraphs(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with paragraphs: entities decoded, lines collapsed, blank ones left out."""
    return rows.withColumn("paragraphs", paragraphs_of(unescaped_html(F.col(text_col))))


def paragraphs_of(text: Column) -> Column:
    """Lines of a decoded text, collapsed, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: collapse(p)), lambda p: p != "")


def uncached(files: DataFrame, parsed: DataFrame, parser_version: int) -> DataFrame:
    """Files whose id was not yet parsed by this version."""
    return files.join(parsed.where(F.col("parser_version") == parser_version).select("book_id"), "book_id", "left_anti")
