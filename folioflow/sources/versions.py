"""Tables of one key that are replaced together, all or nothing, and read by key.

A change writes the rows of the touched buckets to folders of a new version and then appends one row to a log; the
log row appears by one rename of Spark's own commit, and readers go by the log. A run that stops before it leaves
folders that nobody reads, and the next change writes over them. One writer at a time is assumed.

Buckets are a partition column (a hash of the key), and files are sorted by key and order columns, so that a read
of some keys touches their buckets only. A bucket's rows are dealt by ranges when written, so one key of many rows makes several files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "version long, tables array<string>, buckets array<int>"


class Versions:
    """``tables`` maps names to (schema, order columns); every schema holds ``key``, a column that is never null."""

    def __init__(self, spark: SparkSession, path: str, key: str, tables: dict[str, tuple[str, list[str]]], buckets: int = 32, fmt: str = "parquet"):
        self.spark, self.path, self.key, self.tables, self.buckets, self.fmt = spark, path.rstrip("/"), key, tables, buckets, fmt

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def live(self, table: str) -> dict[int, int]:
        """Bucket to the version that last replaced it in ``table``; at most ``buckets`` entries."""
        log = self._log()
        if log is None:
            return {}
        rows = log.where(F.array_contains("tables", table)).select("version", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("version").alias("version")).collect()
        return {r["bucket"]: r["version"] for r in rows}

    def last(self) -> int:
        """The last version, 0 before the first."""
        log = self._log()
        return 0 if log is None else log.agg(F.max("version")).first()[0] or 0

    def _schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(self.tables[table][0])

    def _scan(self, table: str, wanted: Iterable[int] | None = None) -> DataFrame:
        """Rows with their bucket, from the live folders of the wanted buckets."""
        schema = self._schema(table)
        by_version: dict[int, list[int]] = {}
        for bucket, version in self.live(table).items():
            if wanted is None or bucket in wanted:
                by_version.setdefault(version, []).append(bucket)
        found = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
        for version, held in sorted(by_version.items()):
            rows = self.spark.read.format(self.fmt).schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).load(f"{self.path}/{table}/version={version}")
            rows = rows.where(F.col("bucket").isin(held))
            found = rows if version == min(by_version) else found.unionByName(rows)
        return found

    def read(self, table: str) -> DataFrame:
        return self._scan(table).drop("bucket")

    def lookup(self, table: str, *keys) -> DataFrame:
        """Rows of a few keys: reads the files of their buckets, within them what the files' key ranges allow."""
        kind = self._schema(table)[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        wanted = {r[0] for r in asked.select(self.bucket_of(F.col("k"))).collect()}
        return self._scan(table, wanted).where(F.col(self.key).isin(list(keys))).drop("bucket")

    def lookups(self, table: str, requests: DataFrame, on: list[str]) -> DataFrame:
        """Rows of ``table`` that ``requests`` ask for by the columns ``on``, the key among them, with the requests' columns."""
        rows = self._scan(table)
        return requests.withColumn("bucket", self.bucket_of(F.col(self.key))).join(rows, ["bucket", *on]).drop("bucket")

    def replace(self, keys: DataFrame, drop: Iterable[str] = (), **rows: DataFrame) -> int:
        """In the tables of ``rows``, the rows of ``keys`` and of the keys given give way to those given; tables in ``drop`` lose them. Others stay as they are.

        All of it becomes visible at once. Returns the version. Callers pass tables they have written before, as rows are read more than once.
        """
        key = F.col(self.key)
        gone = keys.select(key)
        for new in rows.values():
            gone = gone.union(new.select(key))
        gone = gone.distinct()
        touched = sorted(r[0] for r in gone.select(self.bucket_of(key)).distinct().collect())
        version = self.last() + 1
        if not touched:
            return version - 1
        changed = [t for t in self.tables if t in rows or t in set(drop)]
        for table in changed:
            held = self._scan(table, set(touched)).drop("bucket").join(gone, self.key, "left_anti")
            whole = held.unionByName(rows[table].select(*held.columns)) if table in rows else held
            sort = ["bucket", self.key, *self.tables[table][1]]
            self._write(table, version, whole.withColumn("bucket", self.bucket_of(key)).repartitionByRange(*sort).sortWithinPartitions(*sort))
        self._commit(version, changed, touched)
        return version

    def _write(self, table: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").format(self.fmt).partitionBy("bucket").save(f"{self.path}/{table}/version={version}")

    def _commit(self, version: int, changed: list[str], touched: list[int]) -> None:
        self.spark.createDataFrame([(version, changed, touched)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def json_documents(spark: SparkSession, path: str, key: str, schema: str, buckets: int = 32) -> Versions:
    """A sink of JSON lines with the same promise: readers see the old documents of a key or the new ones, never a part."""
    return Versions(spark, path, key, {"documents": (schema, [])}, buckets, "json")
