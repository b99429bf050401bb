"""Sharding by histogram sort: shards of near-equal bytes, found by counting and filled by one exchange.

Rows are ordered by (hash of the text, hash of the id), so copies of a text lie side by side. Exact bytes below candidate key
boundaries are counted across all partitions; only the buckets that hold a wanted splitter are counted again, at finer probes,
until each splitter is within tolerance. A bucket that shrank to a single text hash (a large group of copies) is refined
along the id hash instead, so a group is only cut when keeping it whole would break the tolerance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SHARDS = 8
TOLERANCE = 0.002  # of a shard's ideal bytes
STEP_BITS = 10  # each pass divides a bucket into 1024 probes
SLICES = 16  # key ranges a shard is dealt to, found by the same counts as the shards
SLICE_BYTES = 256 << 20  # a larger range is dealt on by the hash's place within it
WIDTH = 126  # key bits: 63 of the text hash, then 63 of the id hash


def _part(bits_from: int, bits_to: int) -> Column:
    """Key bits [bits_from, bits_to) counted from the most significant, for the two 63-bit columns ``k1`` and ``k2``."""
    out = F.lit(0).cast("long")
    for name, start in (("k1", 0), ("k2", 63)):
        lo, hi = max(bits_from, start), min(bits_to, start + 63)
        if lo < hi:
            piece = F.shiftright(F.col(name), start + 63 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            out = F.shiftleft(out, hi - lo).bitwiseOR(piece)
    return out


def _in_prefix(prefix: int, bits: int) -> Column:
    """Rows whose first ``bits`` key bits equal ``prefix``."""
    if bits <= 63:
        return F.shiftright(F.col("k1"), 63 - bits) == F.lit(prefix)
    return (F.col("k1") == F.lit(prefix >> (bits - 63))) & (F.shiftright(F.col("k2"), 126 - bits) == F.lit(prefix & ((1 << (bits - 63)) - 1)))


def splitters(keys: DataFrame, wanted: list[tuple[float, float]]) -> list[int]:
    """126-bit keys; splitter j has ``wanted[j] = (bytes, slack)`` bytes below it.

    ``keys`` has k1, k2 and n (bytes). Each pass is one aggregate whose result has at most ``len(wanted) * 1024`` rows, whatever
    the input. A splitter stops once within its slack, or when its bucket is one key (rows with one key cannot be told apart).
    A bucket that holds a single text hash goes on at the first bit of the id hash.
    """
    open_ = {j: (0, 0, 0) for j in range(len(wanted))}  # splitter -> (prefix, bits, bytes below the prefix's range)
    found = [0] * len(wanted)
    while open_:
        bits = min(v[1] for v in open_.values())
        prefixes = sorted({v[0] for v in open_.values() if v[1] == bits})
        step = min(STEP_BITS, (63 if bits < 63 else WIDTH) - bits)
        tag = F.lit(0) if bits == 0 else F.coalesce(*[F.when(_in_prefix(p, bits), F.lit(i)) for i, p in enumerate(prefixes)])
        cells = keys.select(tag.alias("b"), _part(bits, bits + step).alias("c"), "n", "k1", "k2").filter(F.col("b").isNotNull())
        counts = cells.groupBy("b", "c").agg(F.sum("n").alias("n"), *[f("k" + k).alias(n + k) for f, n in ((F.min, "lo"), (F.max, "hi")) for k in "12"]).collect()
        by_prefix: dict[int, list] = {}
        for r in counts:
            by_prefix.setdefault(prefixes[r["b"]], []).append(r)
        for j, (prefix, at, below) in list(open_.items()):
            if at != bits:
                continue
            target, slack = wanted[j]
            place = None
            for r in sorted(by_prefix.get(prefix, []), key=lambda r: r["c"]):
                start, left = (prefix << step) | r["c"], WIDTH - bits - step
                under, over = abs(below - target), abs(below + r["n"] - target)
                if below + r["n"] < target - slack:
                    below += r["n"]
                    continue
                one_text = r["lo1"] == r["hi1"]
                if min(under, over) <= slack or one_text and r["lo2"] == r["hi2"] or left == 0:
                    place = start << left if under <= over else (start + 1) << left
                elif one_text and bits + step < 63:
                    open_[j] = (r["lo1"], 63, below)
                    place = -1
                else:
                    open_[j] = (start, bits + step, below)
                    place = -1
                break
            if place is None:
                place = (prefix + 1) << (WIDTH - bits)
            if place >= 0:
                found[j] = place
                del open_[j]
    return found


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` plus size, shard and slot (gapless from 0 in each shard, in key order); they win over like-named columns.

    Size is the UTF-8 bytes of the text plus 1. Each boundary is within ``tolerance`` of an ideal shard's bytes unless a single row,
    or rows that agree in id and text, are larger than that.

    Defined cases: a null text has size 1. Null ids hash like a value of their own. Repeated rows share a key: they stay in one shard
    and take consecutive slots. With fewer rows than shards some shards are empty; an empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.lit((1 << 63) - 1)
    k1 = F.xxhash64(text).bitwiseAND(mask)
    k2 = F.xxhash64(F.lit(17), F.col(id_col)).bitwiseAND(mask)
    size = (F.octet_length(text) + 1).cast("long")
    keys = scratch.keep(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("n")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    # one list of boundaries: those of the shards, and looser ones that divide the sorting work within a shard
    parts = shards * SLICES
    wanted = [(total * j / parts, (0.5 / parts if j % SLICES else tolerance / shards) * total) for j in range(1, parts)]
    places = splitters(keys, wanted)
    bounds = sorted((b, j % SLICES == 0) for j, b in enumerate(places, 1))
    edges, shard = [(0, 0)], 0
    for b, is_shard in bounds:
        shard += is_shard
        edges.append((b, shard))
    top = 1 << WIDTH
    ends = [*[e[0] for e in edges[1:]], top]
    limit, cut = (1 << 63) - 1, max(1, math.ceil(total / len(edges) / SLICE_BYTES))
    names = {"slice": "int", "shard": "int", "from1": "long", "to1": "long", "from2": "long", "to2": "long"}
    spans = [(i, shard, min(lo >> 63, limit), min(hi >> 63, limit), lo & limit, hi & limit) for i, ((lo, shard), hi) in enumerate(zip(edges, ends))]
    owner = spark.createDataFrame(spans, ", ".join(f"{c} {k}" for c, k in names.items()))  # shards * SLICES rows
    slice_of = _slice_expr([e[0] for e in edges[1:]])
    one = F.col("from1") == F.col("to1")  # a range within one text's copies goes by the hash of the id
    place = lambda k, lo, hi: (F.col(k) - F.col(lo)).cast("double") / F.greatest((F.col(hi) - F.col(lo)).cast("double"), F.lit(1.0))
    share = F.when(one, place("k2", "from2", "to2")).otherwise(place("k1", "from1", "to1"))
    part = F.least(F.floor(share * cut), F.lit(cut - 1)).cast("int")  # rises with the key, so parts keep its order
    dealt = lambda df: df.withColumn("slice", slice_of).join(F.broadcast(owner), "slice").withColumn("part", part)
    counts = dealt(keys).groupBy("shard", "slice", "part").count()
    w = Window.partitionBy("shard").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("slice", "part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    flat = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]
    rows = dealt(docs.select(*flat, k1.alias("k1"), k2.alias("k2"), size.alias("size")))
    nth = F.row_number().over(Window.partitionBy("slice", "part").orderBy("k1", "k2"))
    out = rows.withColumn("nth", nth).join(offsets, ["slice", "part"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "size", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))


def _slice_expr(bounds: list[int]) -> Column:
    """Number of boundaries at or below the row's key, by binary search written as nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        b1, b2 = min(bounds[mid] >> 63, (1 << 63) - 1), bounds[mid] & ((1 << 63) - 1)
        if bounds[mid] >> 63 > (1 << 63) - 1:
            return search(lo, mid)
        below = F.col("k1") < b1 if b2 == 0 else (F.col("k1") < b1) | ((F.col("k1") == b1) & (F.col("k2") < b2))
        return F.when(below, search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds)).cast("int")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    out = shard_by_bytes(docs.withColumn("text_crc32", crc))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
