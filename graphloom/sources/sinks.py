"""Sinks (S9, S10, S12) and GeoJSON files (S11). What replaces something is written beside it and renamed at the end."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialised

TYPE_COLLECTION = '{"type":"FeatureCollection","features":['


class Store:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self._fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.at(path))

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self.at(old), self.at(new))

    def delete(self, path: str) -> None:
        self._fs.delete(self.at(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self.at(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(path)))

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self.at(path)).getLen()

    def write(self, path: str, text: str) -> None:
        """A small file as a whole."""
        staged = f"{path}.staged-{uuid.uuid4().hex}"
        out = self._fs.create(self.at(staged), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.rename(staged, path):
            self.delete(staged)
            raise FileExistsError(path)

    def swap(self, staged: str, target: str) -> None:
        """Put what is staged in the target's place; the old goes when the new is in place, and comes back if it can't be."""
        old = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
        kept = self.exists(target)
        if kept and not self.rename(target, old):
            raise RuntimeError(f"could not move what is at {target} aside")
        if not self.rename(staged, target):
            if kept:
                self.rename(old, target)
            raise RuntimeError(f"could not move the new files to {target}")
        if kept:
            self.delete(old)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Replace a Parquet table as a whole. The new rows are written beside it first, so a table may be rebuilt from itself."""
    store, staged = Store(df.sparkSession, path), f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    store.swap(staged, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_scrape_log(products: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append {site, product} lines and, for finished sites (site, status), {_site_done, status} lines."""
    rest = [c for c in products.columns if c != "site"]
    products.select("site", F.struct(*rest).alias("product")).write.mode("append").json(path)
    if done is not None:
        done.select(F.col("site").alias("_site_done"), "status").write.mode("append").json(path)


def write_geojson(features: DataFrame, path: str, column: str = "feature") -> None:
    """Newline-delimited GeoJSON, a feature per line."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_feature_collection(features: DataFrame, path: str, column: str = "feature", order: Sequence[str] | None = None) -> list[str]:
    """One GeoJSON FeatureCollection of any size as part files: laid end to end in the order of manifest.json they are the document.

    Features are sorted over all partitions, a line each, so no row and no task holds more than its own features. The head opens the
    array, each feature but the first begins with a comma, and the tail closes it. Null features are left out. Returns the names.
    """
    spark, staged = features.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    store = Store(spark, path)
    chosen = features.where(F.col(column).isNotNull()).orderBy(*(order or [column])).select(F.col(column).alias("_f"), F.monotonically_increasing_id().alias("_at"))
    placed = materialised(chosen, "features")
    first = placed.agg(F.min("_at")).first()[0]
    line = F.concat(F.when(F.col("_at") == F.lit(first), "").otherwise(","), "_f")
    # rows of equal places go to one file, and files are numbered by their range
    placed.repartitionByRange("_at").sortWithinPartitions("_at").select(line.alias("value")).write.text(staged)
    parts = [n for n in store.names(staged) if n.startswith("part-")]
    for name, text in (("head.json", TYPE_COLLECTION + "\n"), ("tail.json", "]}\n")):
        store.write(f"{staged}/{name}", text)
    names = ["head.json", *parts, "tail.json"]
    store.write(f"{staged}/manifest.json", json.dumps({"files": [{"name": n, "bytes": store.size(f"{staged}/{n}")} for n in names]}))
    store.swap(staged, path)
    return names


def export_tables(tables: Mapping[str, DataFrame], path: str, columns: Mapping[str, Mapping[str, str]] | None = None, expected: Mapping[str, int] | None = None) -> dict[str, int]:
    """Write several tables as one export, <path>/<table>, and return their row counts; an export that is not whole leaves the old one in place.

    ``columns`` gives tables their columns, name -> type: these are matched by name and cast, absent ones are null and others are left
    out; a table that is named there alone is written empty. Each table is read back and its rows counted against ``expected``, or
    against the frame's own count. All tables are staged, and one rename puts them in place.
    """
    if not tables and not columns:
        raise ValueError("no table to export")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    store, staged = Store(spark, path), f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    counts = {}
    try:
        for name in [*tables, *(n for n in columns or {} if n not in tables)]:
            wanted = (columns or {}).get(name)
            df = tables[name] if name in tables else spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in wanted.items()))
            if wanted is not None:
                df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()))
            df.write.parquet(f"{staged}/{name}")
            counts[name] = spark.read.schema(df.schema).parquet(f"{staged}/{name}").count()
            due = expected[name] if expected is not None and name in expected else df.count()
            if counts[name] != due:
                raise RuntimeError(f"row counts differ for {name}: {due} wanted, {counts[name]} written")
        store.swap(staged, path)
    except BaseException:
        store.delete(staged)
        raise
    return counts


class Ledger:
    """A table of batches, each written whole under its number and entered into a ledger when it is; only entered batches are rows of the table.

    A batch that comes again after a crash changes nothing: not entered, its rows are replaced as a whole; entered, it is passed over.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def finished(self) -> list[int]:
        at = f"{self.path}/ledger"
        return sorted(int(n) for n in self.store.names(at) if n.isdigit()) if self.store.exists(at) else []

    def add(self, batch: int, rows: DataFrame) -> bool:
        """Write a batch and enter it; False if it has been entered before."""
        if self.store.exists(f"{self.path}/ledger/{batch}"):
            return False
        self.store.make(f"{self.path}/ledger")
        write_table(rows, f"{self.path}/rows/batch={batch}")
        self.store.write(f"{self.path}/ledger/{batch}", json.dumps({"batch": batch}))
        return True

    def read(self, schema: str, key: Sequence[str] | None = None) -> DataFrame:
        """All rows of finished batches with their number; with ``key`` those of the last batch that has the key."""
        done = self.finished()
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(schema + ", batch long").option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/batch={b}" for b in done))
        if key is None:
            return rows
        last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*key, "batch"], "left_semi")
