"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are placed longest first into
the open sequence that has room in every capacity and whose weighted residual after placement has the smallest norm. The
decision depends on a piece's length alone, so it is made once per length on the histogram of lengths, for whole groups of
alike sequences at a time; its size is bounded by the capacity, not by the input. The plan is then joined to the pieces by
length and rank among the pieces of that length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, ship
from .tokens import default_vocabulary, encoder, in_pieces

CAPACITY = 2048
END_ID = 0
#: Weights of the residual norm: tokens, documents, attention cost. Tokens decide; the others break ties between equal room.
NORM = (1.0, 1e-4, 1e-4)
#: Pieces of one length are ranked in parts of about this many, so that one frequent length is never in one task.
RANKED_TOGETHER = 500_000
LEAST_PARTS = 32
#: Texts that a worker is handed at a time: it holds two lots of them, and the executor one more outside its heap.
TEXTS = 1000


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """Per piece: d (the id), piece, start, length, ids_crc32. The ids of a text are followed by ``END_ID``; a null text has just that."""

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in in_pieces(batch, ["d", "t"], "t"):
                ids, texts = part.column("d"), part.column("t").to_pylist()
                rows, out = [], ([], [], [], [])
                for i, body in enumerate(encode(texts)):
                    body = memoryview(body + END_ID.to_bytes(4, "little"))
                    n, start, piece = len(body) // 4, 0, 0
                    while start < n:
                        end = start + ((n - start) % capacity or capacity)
                        rows.append(i)
                        for column, x in zip(out, (piece, start, end - start, zlib.crc32(body[4 * start : 4 * end]))):
                            column.append(x)
                        start, piece = end, piece + 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:]]], names=["d", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("d", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int, max_docs: int, max_cost: int) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit, longest first: rows (length, first rank, end rank, pieces per sequence, first sequence, offset).

    A group is a run of sequences with equal residuals. An item goes to the feasible group of the smallest residual norm and fills its
    sequences one after the other, which is what placing the items one by one would do. Every step uses up a length or a group, and
    a length leaves at most two groups more, so there are at most capacity * 2 * capacity steps whatever the counts.
    A piece over a capacity by itself gets a sequence of its own.
    """
    caps = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    weights = np.array(NORM) / caps
    room = np.zeros((0, 3), dtype=np.int64)
    first, many = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length])
        count, rank = histogram[length], 0
        fits = np.all(room >= need, axis=1)
        while rank < count:
            where = np.flatnonzero(fits)
            if len(where):
                norms = np.sqrt((((room[where] - need) * weights) ** 2).sum(axis=1))
                g = where[int(np.argmin(norms))]
            else:
                each = max(1, int((caps // need).min()))
                fresh = math.ceil((count - rank) / each)
                room = np.vstack([room, caps.astype(np.int64)[None]])
                first, many, fits = np.append(first, opened), np.append(many, fresh), np.append(fits, True)
                opened += fresh
                g = len(room) - 1
            each = max(1, int((room[g] // need).min()))
            left, offset, start = count - rank, capacity - int(room[g][0]), int(first[g])
            full = min(left // each, int(many[g]))
            for k, n in ((each, full), (left - full * each, 1 if full < many[g] and left - full * each > 0 else 0)):
                if not n:
                    continue
                out.append((length, rank, rank + k * n, k, start, offset))
                rank += k * n
                room = np.vstack([room, room[g] - k * need])
                first, many, fits = np.append(first, start), np.append(many, n), np.append(fits, False)
                start += n
            used = start - int(first[g])
            if used == many[g]:
                fits[g], room[g] = False, 0
            else:
                first[g], many[g] = start, many[g] - used
        live = room[:, 0] > 0
        room, first, many = room[live], first[live], many[live]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with their place: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_docs`` and ``max_cost`` default to values that a full sequence can just reach, so that tokens alone bind.

    Defined cases: a null or empty text is one piece of one id. Only documents longer than ``capacity`` are cut; their first piece is the
    shorter one. Repeated rows and rows of null id are packed each for itself. An empty table gives an empty table. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    pieces = scratch.keep(pieces_of(docs, id_col, text_col, capacity, vocabulary or default_vocabulary()), "pieces", TEXTS)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps = plan(histogram, capacity, max_docs or capacity, max_cost or capacity * capacity)
    parts = max(LEAST_PARTS, math.ceil(max(histogram.values(), default=1) / RANKED_TOGETHER))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("d", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = scratch.keep(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    names = ("length", "from", "to", "each", "first", "base")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])
    steps = spark.createDataFrame(steps, schema)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("length", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    # each part of a length meets only the steps that its own ranks fall into
    spans = spans.join(steps, "length").filter((F.col("from") < F.col("skip") + F.col("n")) & (F.col("to") > F.col("skip"))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("d", "piece", "ids_crc32", "start")) - 1
    placed = dealt.withColumn("own", own).join(spans, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("skip"))
    placed = placed.filter((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    at = F.col("rank") - F.col("from")
    sequence = F.col("first") + F.floor(at / F.col("each"))
    offset = F.col("base") + (at % F.col("each")) * F.col("length")
    return placed.select(F.col("d").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
