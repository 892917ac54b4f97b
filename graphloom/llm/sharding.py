"""K-d tree sharding: recursive splits at distributed weighted medians.

The dimensions are metadata: the document's columns that are named (language and source, if it has them), the length of the text and
its share of letters beyond ASCII. All are ranked by weight: a value's coordinate is the share of all bytes that lie at lesser values,
with half of its own, in ``BITS`` bits. Numbers lie in the order of their size; named values, which have none, in the order of their
weight. So a dimension is as wide in a node as the share of the corpus between its least and greatest value there, whatever it measures.
In each round every node that is still too large is split along the dimension in which it is widest, so that its two sides weigh as the shards they will hold. The median is found by radix
descent: a histogram of the next bits of the coordinate for all nodes at once, summed by Spark, picks the bin that holds the
median. Rows that tie at the median go by a hash of the text, found in the same way, and only if the rows of that
hash outweigh ``SLACK`` of the goal by a hash of the id. Only such histograms come to the driver, and the weights of ``NAMED`` values of a column: nodes x 2**STEP rows at
most, whatever the input. Values beyond the ``NAMED`` heaviest of a column share the rest of its range by a hash.

Rows of equal text have equal coordinates (of named columns the least place among them counts), so a group of copies stays in
one shard unless it is too heavy; then it is split, which keeps sizes near equal even if one group outweighs a shard.

Nulls, ties and odd rows: a null text has size 16 and no checksum; null metadata is a value of its own; a null id is
hashed like any other. Repeated rows tie in all bits and fall on one side together. A text of any length is one row. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, ship_by_value, stored

BITS, STEP = 24, 12
TOP = (1 << BITS) - 1
#: Values of a named column that have a place of their own.
NAMED = 1024
#: Share of a side's goal up to which rows of equal text are not split.
SLACK = 0.005
#: Rows that are numbered together in one task.
BLOCK_ROWS = 50_000


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [None if t is None else zlib.crc32(t) for t in byte_texts(batch.column("text"))]
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sums, pa.int64())], names=[*keep, "text_crc32"])


def _weights(df: DataFrame, nodes: dict[int, dict], shift: int) -> dict[int, dict[int, tuple[int, int]]]:
    """Per node that is being split, weight and rows of each value of the next bits below its path."""
    cases = None
    for node, s in nodes.items():
        value = F.col(s["by"])
        hit = (F.col("node") == node) & (F.shiftright(value, shift + STEP) == s["path"])
        bin_ = F.shiftright(value, shift).bitwiseAND(F.lit((1 << STEP) - 1))
        cases = F.when(hit, bin_) if cases is None else cases.when(hit, bin_)
    found = df.select("node", cases.alias("bin"), "size").where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
    out: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in found:
        out[r.node][r.bin] = (r.w, r.n)
    return out


def _descend(df: DataFrame, nodes: dict[int, dict]) -> None:
    """Fix the coordinate ``path`` at which each node's left side has the weight ``goal``, the part of ``goal`` left within that value, and the weight and rows of it."""
    if not nodes:
        return
    for s in nodes.values():
        s["path"] = 0
    for shift in range(BITS - STEP, -1, -STEP):
        for node, bins in _weights(df, nodes, shift).items():
            s = nodes[node]
            for b in sorted(bins):
                if s["goal"] < bins[b][0] or b == max(bins):
                    s["path"], (s["inside"], s["rows"]) = s["path"] << STEP | b, bins[b]
                    break
                s["goal"] -= bins[b][0]


def _whole(s: dict) -> None:
    """Put all rows at the path on the side that comes nearer to its goal."""
    s["path"] += 2 * s["goal"] >= s["inside"]


def kd_assign(df: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to rows with size, tie_text and tie_id (hashes of BITS bits) and dimensions of BITS bits."""
    df = df.withColumn("node", F.lit(0))
    pending = {0: (0, shards)}  # node: first shard and number of shards
    fixed: dict[int, int] = {}
    while split := {n: x for n, x in pending.items() if x[1] > 1}:
        for n in [n for n in pending if n not in split]:
            fixed[n] = pending.pop(n)[0]
        spread = df.where(F.col("node").isin(list(split))).groupBy("node").agg(F.sum("size").alias("size"), *(F.min(d).alias(f"min_{d}") for d in dimensions), *(F.max(d).alias(f"max_{d}") for d in dimensions)).collect()
        if not spread:  # an empty table
            break
        # each node's cuts: by its widest dimension, at the median by the text's hash, at that by the id's
        cuts: dict[int, list[dict]] = {}
        for r in spread:
            n_left = split[r.node][1] // 2
            by = max(dimensions, key=lambda d, r=r: r[f"max_{d}"] - r[f"min_{d}"])
            goal = r["size"] * n_left / split[r.node][1]
            cuts[r.node] = [{"by": by, "goal": goal, "slack": SLACK * goal}]
        inside = F.lit(True)
        for by in ("tie_text", "tie_id", None):
            _descend(df.where(inside), {n: c[-1] for n, c in cuts.items() if "path" not in c[-1]})
            inside = F.lit(False)
            for n, c in cuts.items():
                s = c[-1]
                if "done" in s:
                    continue
                # one row, or rows of one text that weigh little, are not split further
                if by is None or s["rows"] == 1 or (by == "tie_id" and s["inside"] <= s["slack"]):
                    _whole(s)
                    s["done"] = True
                    continue
                at = F.col("node") == n
                for x in c:
                    at &= F.col(x["by"]) == x["path"]
                inside |= at
                c.append({"by": by, "goal": s["goal"], "slack": s["slack"]})
        base = 2 * max([*split, *fixed, *pending]) + 1
        case, pending = None, {}
        for k, (n, (first, count)) in enumerate(sorted(split.items())):
            left, right = base + 2 * k, base + 2 * k + 1
            pending[left], pending[right] = (first, count // 2), (first + count // 2, count - count // 2)
            if n not in cuts:  # no rows
                continue
            goes_left = F.lit(False)
            for s in reversed(cuts[n]):
                goes_left = (F.col(s["by"]) < s["path"]) | ((F.col(s["by"]) == s["path"]) & goes_left)
            side = F.when(goes_left, left).otherwise(right)
            case = F.when(F.col("node") == n, side) if case is None else case.when(F.col("node") == n, side)
        if case is not None:
            df = df.withColumn("node", case.otherwise(F.col("node")))
            df = stored(df, "kd-level")
    fixed |= {n: first for n, (first, _) in pending.items()}
    numbers = F.create_map(*(F.lit(x) for n, shard in fixed.items() for x in (n, shard)))
    return df.withColumn("shard", numbers[F.col("node")]).drop("node")


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Add ``slot``, gapless from 0 within each group, by numbering blocks of bounded size and adding up the blocks before."""
    from pyspark.sql import Window

    n = df.count()
    blocks = max(8, -(-n // BLOCK_ROWS))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = df.groupBy(group, "_block").count()
    before = counts.select(group, "_block", (F.sum("count").over(Window.partitionBy(group).orderBy("_block")) - F.col("count")).alias("_before"))
    row = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return df.withColumn("_row", row).join(before, [group, "_block"]).withColumn("slot", (F.col("_row") + F.col("_before")).cast("long")).drop("_block", "_row", "_before")


def _ranked_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raw coordinates of BITS bits as ranks by weight: exact at the borders of 2**STEP bins of raw values, in proportion within a bin."""
    for c in columns:
        low = F.shiftright(F.col(c), BITS - STEP)
        weights = {r.bin: int(r.w) for r in df.groupBy(low.alias("bin")).agg(F.sum("size").alias("w")).collect()}
        total, edges = max(1, sum(weights.values())), [0]
        for b in range(1 << STEP):
            edges.append(edges[-1] + weights.get(b, 0))
        edges = [int(e * TOP / total) for e in edges]
        table = F.lit(edges)
        within = F.col(c).bitwiseAND(F.lit((1 << (BITS - STEP)) - 1)) / float(1 << (BITS - STEP))
        at, after = F.get(table, low), F.get(table, low + 1)
        df = df.withColumn(c, F.floor(at + (after - at) * within).cast("int"))
    return df


def _ranked_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named values as ranks by weight, the heaviest first; null is a value."""
    for c in columns:
        heaviest = df.groupBy(c).agg(F.sum("size").alias("w")).orderBy(F.desc("w"), c).limit(NAMED).collect()
        total = max(1, int(df.agg(F.sum("size")).first()[0] or 0))
        before, rows = 0, []
        for r in heaviest:
            rows.append((r[c], int((before + r["w"] / 2) * TOP / total)))
            before += int(r["w"])
        named = F.create_map(*(F.lit(x) for name, at in rows if name is not None for x in (name, at))) if any(n is not None for n, _ in rows) else F.lit(None).cast("map<string,int>")
        nothing = next((at for name, at in rows if name is None), TOP)
        left = int(before * TOP / total)
        rest = F.lit(left) + F.floor(F.shiftrightunsigned(F.xxhash64(c), 64 - BITS) / float(1 << BITS) * (TOP - left))
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.lit(nothing)).otherwise(F.coalesce(F.try_element_at(named, F.col(c)), rest)).cast("int"))
    return df


def kd_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, metadata: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Shards 0 to ``shards`` - 1 of near equal size: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes).

    Of ``metadata`` the columns that there are serve as dimensions, beside length and script.
    """
    named = [c for c in metadata if c in docs.columns]
    lengths = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    bits = lambda c: F.shiftrightunsigned(c, 64 - BITS).cast("int")
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (lengths + overhead).alias("size"),
        F.least(F.log2(lengths + 1) / 40 * TOP, F.lit(TOP)).cast("int").alias("d_length"),
        F.when(lengths > 0, (lengths - F.length(text_col)) / lengths * TOP).otherwise(0).cast("int").alias("d_script"),
        *(F.col(f"`{c}`").cast("string").alias(f"d_named{k}") for k, c in enumerate(named)),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        bits(F.xxhash64(F.col(id_col), F.lit("tie"))).alias("tie_id"),
    )
    kept = [c for c in words.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema if f.name in kept) + ", text_crc32 long"
    slim = stored(words.mapInArrow(_checksums, schema), "sizes")
    of_text = [f"d_named{k}" for k in range(len(named))]
    slim = _ranked_numbers(_ranked_names(slim, of_text), ["d_length", "d_script"])
    if named:  # copies take the least place among them; most texts have one alone and need no join
        again = stored(slim.groupBy("text_hash").agg(*(F.min(c).alias(f"least_{c}") for c in of_text), *(F.max(c).alias(f"most_{c}") for c in of_text)).where(" or ".join(f"least_{c} < most_{c}" for c in of_text)).select("text_hash", *(f"least_{c}" for c in of_text)), "copies")
        slim = slim.join(again, "text_hash", "left").select(*(F.coalesce(f"least_{c}", c).alias(c) if c in of_text else c for c in slim.columns))
    slim = stored(slim.withColumn("tie_text", bits(F.col("text_hash"))).drop("text_hash"), "placed")
    placed = numbered(kd_assign(slim, [*of_text, "d_length", "d_script"], shards), "shard", [F.col("doc_id"), F.col("tie_id"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ship_by_value(__name__)
