"""Token counts as delta-maintained rollups.

Three things are kept under one shared folder. The ledger has signed rows per document: an insert adds (+1 document, +n tokens) to its cell
(source, language, tokenizer version), a delete takes the same amounts away, a revision does both. The totals have one row per cell; a
batch adds the sums of its own signed rows to the totals before it, so reading totals never goes back to the ledger. The log has one
entry per committed batch, in order; it names the attempt whose files count.

A batch writes its ledger rows and its totals to a folder of its own attempt and becomes visible by one log entry, which is renamed into its
place without overwriting. Repeating a batch (a retry, a replay, a lost driver) finds the entry and changes nothing. Two writers cannot take
one place of the log: the second starts again from the totals that the first has left.

Every FOLD-th batch writes the net ledger in place of its own rows alone, and the names of all batches so far. Readers open the log from the last such entry
on, so a batch reads FOLD entries and ledger parts at most however long the history is; data from before the fold before the last one is deleted.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship
from .tokens import default_vocabulary, encoder, in_pieces

CELL = ("source", "lang", "tokenizer")
FOLD = 50  # batches between two folded ledgers
BUCKETS = 256  # parts of the ledger by hash of the document's id; a batch reads those its documents fall into


def count_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``docs`` columns but the text, plus n_tokens (it wins over a like-named column).

    Defined cases: whole texts are encoded; null and empty ones have no token. Null ids and other nulls pass through, repeated rows are counted
    each, other columns pass through whatever their names, and an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens")]
    names = [f"c{i}" for i in range(len(kept))]

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in in_pieces(batch, names, "t"):
                sizes = [len(x) // 4 for x in encode(part.column("t").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    ship(docs.sparkSession)
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, kept)], T.StructField("n_tokens", T.LongType())])
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, kept)], F.col(text_col).alias("t"))
    return flat.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "n_tokens")


class TokenRollup:
    """Totals by source, language and tokenizer version under ``path`` (a folder that all executors share)."""

    AMOUNTS = ("docs", "tokens")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at().getFileSystem(self.conf)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _places(self) -> list[int]:
        """Taken places of the log, in order. They are listed, not opened."""
        if not self.fs.exists(self._at("log")):
            return []
        return sorted(int(n) for s in self.fs.listStatus(self._at("log")) if (n := s.getPath().getName()).isdigit())

    def _entries(self, places: list[int]) -> list[dict]:
        out = []
        for place in places:
            stream = self.fs.open(self._at("log", f"{place:010d}"))
            try:
                out.append({"place": place, **json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))})
            finally:
                stream.close()
        return out

    @staticmethod
    def _folds(place: int) -> bool:
        return (place + 1) % FOLD == 0

    def log(self) -> list[dict]:
        """Committed batches in order (place, batch, attempt), from the last folded one on."""
        places = self._places()
        last = max((p for p in places if self._folds(p)), default=0)
        return self._entries([p for p in places if p >= last])

    def _names(self, log: list[dict]) -> DataFrame:
        """Names (place, batch) of all batches up to a log's last entry."""
        rows = [(e["place"], e["batch"]) for e in log]
        tail = self.spark.createDataFrame(rows, "place int, batch string")
        if not log or not self._folds(log[0]["place"]):
            return tail
        return self.spark.read.schema(tail.schema).parquet(f"{self.path}/attempts/{log[0]['attempt']}/names").unionByName(tail.filter(F.col("place") > log[0]["place"]))

    def committed(self) -> list[str]:
        """Names of the committed batches, in order of commit."""
        return [r.batch for r in self._names(self.log()).orderBy("place").toLocalIterator()]

    def _has(self, log: list[dict], batch: str) -> bool:
        return any(e["batch"] == batch for e in log) or (bool(log) and self._folds(log[0]["place"]) and not self._names(log).filter(F.col("batch") == batch).isEmpty())

    def _forget(self, place: int) -> None:
        """Delete the data of what was committed before the fold before the one at ``place``."""
        for e in self._entries([p for p in self._places() if place - 2 * FOLD <= p < place - FOLD]):
            self.fs.delete(self._at("attempts", e["attempt"]), True)

    def _commit(self, place: int, batch: str, attempt: str) -> bool:
        """Take a place of the log; False if another writer has it."""
        draft = self._at("log", f".{attempt}")
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.conf)
        target = self._at("log", f"{place:010d}")
        if self.fs.exists(target):
            return False
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
        except Exception as error:  # the place was taken in between
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    @staticmethod
    def schema() -> T.StructType:
        cell = [T.StructField(c, T.StringType()) for c in CELL]
        return T.StructType([T.StructField("doc_id", T.LongType()), *cell, T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def ledger(self) -> DataFrame:
        """Signed rows of all committed batches, folded up to the last fold: doc_id, source, lang, tokenizer, docs, tokens, bucket."""
        return self._ledger(self.log())

    def _ledger(self, log: list[dict]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], self.schema())
        parts = [self.spark.read.schema(self.schema()).parquet(f"{self.path}/attempts/{e['attempt']}/ledger") for e in log]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _cells(self, log: list[dict]) -> DataFrame:
        schema = T.StructType([f for f in self.schema() if f.name in (*CELL, *self.AMOUNTS)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/attempts/{log[-1]['attempt']}/totals") if log else self.spark.createDataFrame([], schema)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes: doc_id, source, lang, tokenizer, n_tokens, op ('upsert' or 'delete') and, if there is one, seq. False if already committed.

        An upsert of a document that the ledger holds takes back what it had under that tokenizer version and adds the new count; a delete takes
        back and adds nothing, whatever its other columns say; deleting an unknown document changes nothing. Of several changes to one
        document and version in a batch the one with the largest seq holds; of those with equal seq, or without one, an upsert before a delete,
        then the larger count. A null op is an upsert. Null source, lang or tokenizer are cells of their own, a null count is 0. Changes with a null doc_id are
        plain additions, each by itself: nothing can be taken back by them. An empty batch is committed as any other.
        """
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        # rows without an id get a number of their own, so that one aggregate settles all rows and the texts behind them are read once
        alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", alone.alias("alone"), seq.alias("seq"), (~F.col("op").eqNullSafe("delete")).alias("adds"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), "source", "lang")
        last = rows.groupBy("doc_id", "tokenizer", "alone").agg(F.max(F.struct("seq", "adds", "n", "source", "lang")).alias("c"))
        bucket = F.pmod(F.xxhash64(F.coalesce("doc_id", "alone")), F.lit(BUCKETS)).cast("int")
        scratch = Scratch(self.spark)
        latest = None
        while True:
            log = self.log()
            if self._has(log, batch):
                if latest is not None:
                    scratch.drop(latest)
                return False
            if latest is None:
                latest = scratch.keep(last.select("doc_id", "tokenizer", "c.adds", "c.n", "c.source", "c.lang", bucket.alias("bucket")), "latest")
            attempt = f"{batch}-{uuid.uuid4().hex}"
            folder = f"{self.path}/attempts/{attempt}"
            delta = latest.filter("adds").select("doc_id", *CELL, F.lit(1).cast("long").alias("docs"), F.col("n").alias("tokens"), "bucket")
            if log:
                named = latest.filter("doc_id is not null")
                touched = [r["bucket"] for r in named.select("bucket").distinct().collect()]  # BUCKETS rows at most
                keys = named.select(F.col("doc_id").alias("k1"), F.col("tokenizer").alias("k2"))
                held = self._ledger(log).filter(F.col("bucket").isin(touched)).join(keys, (F.col("doc_id") == F.col("k1")) & F.col("tokenizer").eqNullSafe(F.col("k2")), "left_semi")
                net = held.groupBy("doc_id", *CELL, "bucket").agg(*[F.sum(a).alias(a) for a in self.AMOUNTS]).filter((F.col("docs") != 0) | (F.col("tokens") != 0))
                delta = delta.unionByName(net.select("doc_id", *CELL, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "bucket"))
            place = log[-1]["place"] + 1 if log else 0
            summed = [F.sum(a).alias(a) for a in self.AMOUNTS]
            before = self._cells(log)
            if self._folds(place):
                # rows without an id cannot change any more: they are folded by cell
                delta = self._ledger(log).unionByName(delta).groupBy("doc_id", *CELL, "bucket").agg(*summed).filter((F.col("docs") != 0) | (F.col("tokens") != 0))
                self._names([*log, {"place": place, "batch": batch}]).coalesce(1).write.parquet(f"{folder}/names")
                before = before.limit(0)  # the ledger holds all of it
            delta.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/ledger")
            written = self._ledger([{"attempt": attempt}])
            cells = before.unionByName(written.select(*CELL, *self.AMOUNTS)).groupBy(*CELL).agg(*summed)
            cells.coalesce(1).write.parquet(f"{folder}/totals")  # cells, not documents
            if self._commit(place, batch, attempt):
                scratch.drop(latest)
                if self._folds(place):
                    self._forget(place)
                return True
            self.fs.delete(self._at("attempts", attempt), True)

    def totals(self) -> DataFrame:
        """Per cell: n_docs and n_tokens, as the last batch left them; cells whose documents have all gone are left out.

        Defined cases: no row before the first batch. Null source, lang or tokenizer are cells of their own.
        """
        return self._cells(self.log()).filter("docs <> 0").select(*CELL, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def changes_of(docs: DataFrame, vocabulary: str | None = None, version: str = "byte_bpe_50k", op: str = "upsert") -> DataFrame:
    """Rows of documents (doc_id, text, source, lang) as changes for ``TokenRollup.apply``.

    Defined cases: null and empty texts have no token. Null ids, sources and languages pass through; repeated rows stay, an empty table gives none,
    other columns are ignored.
    """
    counted = count_tokens(docs.select("doc_id", "text", "source", "lang"), "doc_id", "text", vocabulary or default_vocabulary())
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", F.lit(op).alias("op"))


def one_per_document(counted: DataFrame) -> DataFrame:
    """Changes with one row per document and version: of repeated rows the one with the largest count, then the larger source and language. Rows without an id all stay."""
    rest = F.max(F.struct("n_tokens", "source", "lang")).alias("c")
    named = counted.filter("doc_id is not null").groupBy("doc_id", "tokenizer", "op").agg(rest)
    return named.select("doc_id", "c.source", "c.lang", "tokenizer", "c.n_tokens", "op").unionByName(counted.filter("doc_id is null"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of the whole table after a history of batches, each text tokenized once.

    Documents arrive without a language; a revision gives each its language; those without a token are deleted and come back;
    the deletion is replayed, which must not count again. Rows without an id, which no later batch can find, arrive as they are and take part in nothing
    else; repeated rows of an id are one document (``one_per_document``).
    """
    scratch = Scratch(spark)
    counted = scratch.keep(changes_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counted")
    docs = scratch.keep(one_per_document(counted), "docs")
    scratch.drop(counted)
    rollup = TokenRollup(spark, f"{scratch.root}/rollup")
    named = docs.filter("doc_id is not null")
    rollup.apply("arrival", named.withColumn("lang", F.lit(None).cast("string")).unionByName(docs.filter("doc_id is null")))
    rollup.apply("languages", named)
    bare = named.filter("n_tokens = 0")
    rollup.apply("withdrawn", bare.withColumn("op", F.lit("delete")))
    rollup.apply("restored", bare)
    rollup.apply("withdrawn", bare.withColumn("op", F.lit("delete")))
    scratch.drop(docs)
    return rollup.totals()
