"""Tables that jobs update: rows are dealt into buckets, and an upsert rewrites only the buckets it touches.

A bucket is a share of the hashed keys, or a value of an expression over them such as a day or a window of time.

A table is a folder in the shared store: `rows` (Parquet, one folder a bucket), `staged` (buckets of an upsert that
is under way) and `done` (one small file for each batch that is in). An upsert first writes its buckets whole to
`staged` and then moves them to the place of the old ones, so a job that dies at any point is run again with the
same batch number: what was staged is put in place, what wasn't is computed anew from rows that nobody has changed,
and a batch that is done changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder to the place of another one."""
    a, b = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(to)
    remove(spark, to)
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(n for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if (n := f.getPath().getName()).startswith(f"{BUCKET}="))


def replace_rows(keys: list[str]) -> Merge:
    """New rows over old ones of the same key; of several new rows of a key, which must agree, one."""
    return lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


class StoredTable:
    """Rows by key. One writer at a time; readers see whole buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64, by: str | None = None):
        """buckets is fixed when the table is first written: enough that a bucket fits a task, thousands for a large table.

        by: an SQL expression whose values are the buckets, in place of hashed keys; rows of a key must agree on it.
        """
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.by = by or f"pmod(xxhash64({', '.join(keys)}), {buckets})"
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.rows_path, self.staged, self.done = (f"{self.path}/{x}" for x in ("rows", "staged", "done"))
        if exists(spark, f"{self.path}/layout/_SUCCESS"):
            was = spark.read.json(f"{self.path}/layout").first()
            if was["by"] != self.by or was["keys"] != keys:
                raise ValueError(f"{path} has buckets by {was['by']} and keys {was['keys']}")

    def bucket(self) -> Column:
        return F.coalesce(F.expr(self.by).cast("string"), F.lit("none"))

    def read(self, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """All rows, or those in buckets whose name (a string) is `where`; empty before the first upsert."""
        df = self._buckets(None)
        return (df.filter(where(F.col(BUCKET))) if where else df).select(self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of some keys: only their buckets are read."""
        return self.lookup_by(keys.select(*self.keys))

    def lookup_by(self, some: DataFrame) -> DataFrame:
        """Rows that agree with `some` in its columns, which decide the bucket: only their buckets are read."""
        wanted = some.distinct()
        return self._buckets(self._touched(wanted)).join(wanted, some.columns, "left_semi").select(self.schema.names)

    def is_done(self, batch: int) -> bool:
        return exists(self.spark, f"{self.done}/batch={batch}/_SUCCESS")

    def upsert(self, batch: int, rows: DataFrame, merge: Merge | None = None) -> list[str]:
        """Merges rows into the table, once for each batch number; the buckets that were rewritten or emptied.

        merge(old, new) gets a bucket's old rows and the new ones and returns all that stands after it, each key in the
        bucket that it was in. By default new rows replace old ones.
        """
        if self.is_done(batch):
            return []
        rows = rows.select(self.schema.names)
        if merge is None and not exists(self.spark, self.rows_path):
            # into an empty table rows are dealt once, and repeated keys go where they lie
            return self._write(batch, [], lambda: self._dealt(rows).dropDuplicates([BUCKET, *self.keys]))
        touched = self._touched(rows)
        return self._write(batch, touched, lambda: (merge or replace_rows(self.keys))(self._buckets(touched).select(self.schema.names), rows))

    def rewrite(self, batch: int, buckets: list[str], keep: Callable[[DataFrame], DataFrame], drop: list[str] | None = None) -> list[str]:
        """Puts keep(rows) in the place of some buckets' rows, and drops other buckets unread, once for each batch number; all these."""
        return [] if self.is_done(batch) else self._write(batch, [*buckets, *(drop or [])], lambda: keep(self._buckets(buckets).select(self.schema.names)))

    def _write(self, batch: int, touched: list[str], merged: Callable[[], DataFrame]) -> list[str]:
        if not exists(self.spark, f"{self.path}/layout/_SUCCESS"):
            self.spark.createDataFrame([(self.by, self.keys)], "by string, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{self.path}/layout")
        stage, names = f"{self.staged}/batch={batch}", f"{self.staged}/names={batch}"
        if not exists(self.spark, f"{names}/_SUCCESS"):
            if not exists(self.spark, f"{stage}/_SUCCESS"):
                rows = merged()
                rows = rows if BUCKET in rows.columns else self._dealt(rows.select(self.schema.names))
                rows.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(stage)
            # the folders' names are kept before any of them is moved; at most one a bucket
            self.spark.createDataFrame([(n,) for n in _folders(self.spark, stage)], "name string").coalesce(1).write.mode("overwrite").json(names)
        folders = [r["name"] for r in self.spark.read.schema("name string").json(names).collect()]
        for name in folders:
            if exists(self.spark, f"{stage}/{name}"):
                move(self.spark, f"{stage}/{name}", f"{self.rows_path}/{name}")
        filled = [unquote(n.split("=", 1)[1]) for n in folders]
        # a bucket that nothing is left of goes by its name
        for name in set(touched) - set(filled):
            remove(self.spark, f"{self.rows_path}/{BUCKET}={name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.done}/batch={batch}")
        remove(self.spark, stage)
        remove(self.spark, names)
        return sorted({*touched, *filled})

    def bucket_names(self) -> list[str]:
        """Names of the buckets there are, by listing their folders; one a bucket."""
        return sorted(n.split("=", 1)[1] for n in _folders(self.spark, self.rows_path)) if exists(self.spark, self.rows_path) else []

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows of a bucket together, so that it is one file."""
        return rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET)

    def _with_bucket(self) -> StructType:
        return StructType([*self.schema.fields]).add(BUCKET, StringType())

    def _touched(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # at most one a bucket

    def _buckets(self, wanted: list[str] | None) -> DataFrame:
        if not exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], self._with_bucket())
        df = self.spark.read.schema(self._with_bucket()).parquet(self.rows_path)
        return df if wanted is None else df.filter(F.col(BUCKET).isin(wanted))


def append_once(rows: DataFrame, path: str, batch: int) -> None:
    """Rows of a batch in a ledger of their own folder: run again, it has the same rows once."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_ledger(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All batches of a ledger, with `batch`; empty before the first."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*schema.fields]).add("batch", LongType())
    return spark.read.schema(whole).parquet(path) if exists(spark, path) else spark.createDataFrame([], whole)
