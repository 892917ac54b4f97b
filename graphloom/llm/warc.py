"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by id, and each range is one writer, which rolls its files when their compressed size passes a limit.
Headers and digests are made anew from the payload. Equal payloads of ``revisit_bytes`` or more are stored once, in the record of the
largest id; the others become revisit records. A file is written under a temporary name, renamed when complete, and listed in a manifest
that is itself written last; readers take the manifest's files only. Names and contents depend on the rows of a range alone, so
a writer that runs twice, after a lost executor or by speculation, leaves the same files.

Nulls, ties and odd rows: a null payload is empty and a null url is left out; a null id sorts first and is marked as such. Rows that repeat an
id and a large payload share the response of that id: the first of them is written as response, the others revisit it.
Rows of one id share a file's range however heavy they are, and so a task. A payload of any length is one record. An empty table gives a manifest without files. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import write_table
from .common import byte_texts, scratch_dir, ship_by_value, stored

#: Compressed bytes after which a file is closed.
FILE_BYTES = 16 << 20
#: Records carry a fixed date, as pages have none and the output must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"


def record_uri(page_id: int) -> str:
    """A URN whose low 64 bits are the page's id."""
    return f"urn:uuid:{uuid.UUID(int=0x6B1D5C1EA4D08000 << 64 | page_id & (1 << 64) - 1)}"


def _page_id(uri: str) -> int:
    low = uuid.UUID(uri.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(head.encode() + block + b"\r\n\r\n")
    return out.getvalue()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_uri(page_id)}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(payload + (url or '').encode()).hexdigest())}>"),
        ("WARC-Page-ID", "null" if page_id is None else str(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", "".join(url.split()))] if url and url.strip() else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", sha1(payload)),
        ("WARC-Block-Digest", sha1(block)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_uri(refers_to)}>")]
    return _member(headers, block)


def _file_info(name: str) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")


class _Roller:
    """Writes the files of one range."""

    def __init__(self, uri: str, limit: int) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.limit, self.tag, self.out = limit, uuid.uuid4().hex, None

    def begin(self, shard: int) -> None:
        self.shard, self.part = shard, 0

    def write(self, record: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(record) > self.limit:
            yield from self.close()
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{self.tag}"
            self.out, self.sum, self.size, self.records = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, -1
            self.put(_file_info(self.name))
        self.put(record)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temporary, f"{self.path}/{self.name}")
        self.out = None
        self.part += 1
        yield self.name, self.records, self.size, self.sum.hexdigest()


def _write(uri: str, limit: int):
    """Rows come sorted by shard, id and kind: first where an id's payloads are kept (kind 0), then its pages (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roller(uri, limit)
        shard, page, kept_at, answered = None, ("none",), {}, set()
        for batch in batches:
            done: list[tuple] = []
            rows = zip(*(batch.column(k).to_pylist() for k in ("shard", "page_id", "kind", "url", "digest", "refers_to")), byte_texts(batch.column("html")), strict=True)
            for to, page_id, kind, url, digest, refers_to, payload in rows:
                if to != shard:
                    done += files.close()
                    files.begin(to)
                    shard = to
                if (page_id,) != page:
                    page, kept_at, answered = (page_id,), {}, set()
                if kind == 0:
                    kept_at[digest] = refers_to
                    continue
                payload = payload or b""
                digest = hashlib.sha1(payload).hexdigest()
                target = kept_at.get(digest)
                if target is not None and target == page_id and digest not in answered:
                    answered.add(digest)
                    target = None
                done += files.write(page_record(page_id, url, payload, target))
            yield _listing(done)
        yield _listing(list(files.close()))

    return run


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha256"])


#: Bins that a segment of ids is counted in, at most.
BINS = 1024
#: Bins' rows are broadcast up to this number, of some 60 bytes each; beyond it they are joined by a shuffle.
BROADCAST_BINS = 1_000_000


def _assigned(digests: DataFrame, shard_bytes: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What adds ``shard`` to rows with page_id and digest, and the number of shards.

    Ids are counted in bins between the least and the greatest; a bin that is too heavy is cut again between its own least and
    greatest ids, all such bins in one job a level, until each is light enough or a single id. So the cuts follow the ids wherever
    they lie, and come from exact counts. Bins and their weights stay in tables: those of each level are the next one's segments,
    and the shard of a light bin is the sum of all before it over ``shard_bytes``. Rows without an id are dealt out by digest.
    """
    nulls = digests.where("page_id is null").agg(F.sum("size")).first()[0] or 0
    null_shards = max(1, -(-nulls // shard_bytes))
    by_digest = F.pmod(F.xxhash64("digest"), F.lit(null_shards)).cast("int")
    known = digests.where("page_id is not null").select("page_id", "size")
    low, high, total = known.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return lambda df: df.withColumn("shard", by_digest), null_shards
    bins = lambda weight: F.least(F.lit(BINS), F.greatest(F.lit(3), F.ceil(2 * weight / shard_bytes)))
    width = max(1, -(-(high - low + 1) // min(BINS, max(3, -(-2 * total // shard_bytes)))))
    exact = lambda c: f"cast({c} as decimal(38,0))"  # noqa: E731  ids may lie far apart
    levels: list[DataFrame] = []  # seg, bin, next, low, width: bins that are segments of the next level
    leaves: list[DataFrame] = []

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_BINS else table

    def placed(df: DataFrame) -> DataFrame:
        # one segment, of all ids
        df = df.withColumn("seg", F.lit(0).cast("long")).withColumn("bin", F.expr(f"cast(({exact('page_id')} - {low}) div {width} as bigint)"))
        for table in levels:
            inner = F.expr(f"cast(({exact('page_id')} - {exact('low')}) div {exact('width')} as bigint)")
            found = df.join(table, ["seg", "bin"], "left")
            df = found.withColumn("seg", F.coalesce("next", "seg")).withColumn("bin", F.when(F.col("next").isNull(), F.col("bin")).otherwise(inner)).drop("next", "low", "width")
        return df

    while True:
        rows = placed(known)
        if levels:  # only what the last level cut
            rows = rows.join(levels[-1].select(F.col("next").alias("seg")), "seg", "left_semi")
        counts = stored(rows.groupBy("seg", "bin").agg(F.sum("size").alias("w"), F.min("page_id").alias("a"), F.max("page_id").alias("z")), "bins")
        light = (F.col("w") <= shard_bytes) | (F.col("a") == F.col("z"))
        leaves.append(counts.where(light))
        heavy = counts.where(~light)
        if heavy.isEmpty():
            break
        span = F.expr(f"{exact('z')} - {exact('a')} + 1")
        cut = heavy.select("seg", "bin", (F.monotonically_increasing_id() + (len(levels) + 1) * (1 << 56)).alias("next"), F.col("a").alias("low"), F.greatest(F.lit(1), F.ceil(span / bins(F.col("w")))).cast("long").alias("width"))
        levels.append(small(stored(cut, "segments")))
    # weights are summed over ranges of ids, a sum for each range on the driver
    ordered = stored(reduce(DataFrame.unionByName, leaves).repartitionByRange("a").withColumn("part", F.spark_partition_id()), "leaves")
    sums = sorted((r.part, r.w) for r in ordered.groupBy("part").agg(F.sum("w").alias("w")).collect())
    before = dict(zip([k for k, _ in sums], accumulate([0, *(w for _, w in sums)]), strict=False))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")]
    running = F.sum("w").over(Window.partitionBy("part").orderBy("a")) - F.col("w") + offset
    cuts = stored(ordered.select("seg", "bin", (F.floor(running / shard_bytes) + null_shards).cast("int").alias("shard")), "cuts")
    shards = cuts.agg(F.max("shard")).first()[0] + 1
    table = small(cuts)

    def add(df: DataFrame) -> DataFrame:
        found = placed(df).join(table, ["seg", "bin"], "left")
        return found.withColumn("shard", F.when(F.col("page_id").isNull(), by_digest).otherwise(F.col("shard"))).drop("seg", "bin")

    return add, shards


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, file_bytes: int = FILE_BYTES, shard_bytes: int = 4 * FILE_BYTES) -> DataFrame:
    """Write all pages below ``uri`` and return the manifest (file, records, bytes, sha256), which is stored there too."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    digests = stored(rows.select("page_id", F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("digest")), "digests")

    large = digests.where(F.col("size") >= revisit_bytes)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    links = large.select("page_id", "digest").join(kept, "digest").select("page_id", "digest", "refers_to").distinct()

    add_shard, shards = _assigned(digests, shard_bytes)
    own = F.when(F.col("page_id").isNull(), F.sha1("html"))
    everything = rows.select("page_id", F.lit(1).alias("kind"), "url", own.alias("digest"), F.lit(None).cast("long").alias("refers_to"), "html")
    everything = everything.unionByName(links.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "digest", "refers_to", F.lit(None).cast("binary").alias("html")))
    # a task for each shard
    placed = add_shard(everything).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "digest", "html")
    manifest = placed.mapInArrow(_write(uri, file_bytes), "file string, records long, bytes long, sha256 string")
    # the old manifest stands until the new one is whole
    return write_table(manifest, f"{uri}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream."""
    with gzip.GzipFile(fileobj=stream) as z:
        while line := z.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("a record must start with its version")
            headers = {}
            while (line := z.readline()).strip():
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            block = z.read(int(headers["content-length"]))
            yield headers, block


def _read(uri: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if h["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: payload of {h['warc-record-id']} does not match its digest")
                        target = h.get("warc-refers-to")
                        page_id = None if h["warc-page-id"] == "null" else int(h["warc-page-id"])
                        out.append((page_id, n, digest, h["warc-type"], None if target is None else _page_id(target), h.get("warc-target-uri"), name, payload if h["warc-type"] == "response" else None))
                        if len(out) >= 2000:
                            yield _rows(out, with_payload)
                            out = []
                yield _rows(out, with_payload)

    return run


def _rows(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "file": pa.string(), "payload": pa.binary()}
    if not with_payload:
        kinds.pop("payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=False)], names=list(kinds))


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """The page records of all files in the manifest below ``uri``; payload digests of responses are verified."""
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{uri}/_manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string" + ", payload binary" * with_payload
    # as many tasks as files: their sizes are bounded, while the rows that name them are too small to be dealt out by size
    return manifest.repartition(max(1, manifest.count())).mapInArrow(_read(uri, with_payload), schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a fresh folder of the shared scratch space and read the archives back."""
    uri = scratch_dir(pages.sparkSession, "warc")
    write_warc(pages, uri, **options)
    return read_warc(pages.sparkSession, uri, with_payload=False)


ship_by_value(__name__)
