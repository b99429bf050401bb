"""Near-duplicate groups by SetSketch registers.

A document is the set of its word shingles. Each of its registers is the truncated logarithm of a minimum of exponential variables
over the set: register values of two sets agree with a probability that follows their similarity, and the registers of a union
are the maxima of the registers. Bands of registers propose pairs, the joint likelihood of all registers (with the set
sizes, which are known exactly) drops pairs that cannot reach the threshold, and the full sets decide. The likelihood acts on the first
round (each member against the leads of its buckets) only; in the second, full sets are compared right inside the join, after set
sizes alone: a test of registers there would have to write the pairs first.

Documents with equal sets are one class from the start, told apart by 128 bits that go back to two hashes of each word. In a bucket of a band, every member is first tried against one member
(three random orders choose it); what is linked is merged. Only buckets that still hold several components are then gone
through, and only between components: copies of one text cost work in proportion to their number, and no link is lost. What
remains quadratic are documents of one bucket that resemble each other but are not linked, which only their full sets can tell; a
bucket with many of them is dealt over salts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, salted_lookup, ship
from .hashing import buffers, constants, mix, window_hashes, word_hashes
from .tokens import in_pieces

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 36, 6  # at similarity .8 a linked pair shares no band with probability (1 - .8**6)**36 = 2e-5
B, A, Q = 1.001, 20.0, (1 << 16) - 2  # base, rate and largest register of the sketch
SURE = 18.0  # a pair goes unverified only if the threshold is e**18 times less likely than the best fit
PART_CHARS = 500_000
SPREAD = 1000  # members outside a bucket's largest component that one salt holds
FEW = 10_000  # edges that one task joins at the end
PLAIN_ROWS = 100_000  # edges or labels that a plain join moves: one task of them is small even if all meet in one key


class Sketcher:
    """Shingle sets and registers of Arrow text columns."""

    def __init__(self, size: int, bands: int = BANDS, rows: int = ROWS):
        self.size, self.bands, self.rows = size, bands, rows
        self.factors, self.shifts = constants(bands * rows, 11), constants(bands * rows, 12)
        self.band_factors = constants(bands * rows, 13).reshape(bands, rows)

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shingle hashes, second hashes of the same shingles, first index per row, number per row): each row's distinct shingles in order of hash.

        A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
        """
        data, offsets = buffers(column)
        *both, rows, _ = word_hashes(data, offsets, lower=True)
        count = np.bincount(rows, minlength=len(column))
        few = np.flatnonzero((count > 0) & (count < self.size))
        place = np.cumsum(count) - count
        values = []
        for words, seed in zip(both, (21, 22)):
            value, first = window_hashes(words, rows, self.size, seed)
            short = np.zeros(len(few), dtype=np.uint64)
            for k, c in enumerate(constants(self.size, seed)):
                has = count[few] > k
                short[has] += words[place[few][has] + k] * c
            values.append(np.concatenate([value, mix(short ^ (count[few].astype(np.uint64) << np.uint64(56)))]))
        value, second = values
        owner = np.concatenate([rows[first], few])
        order = np.lexsort((value, owner))
        value, second, owner = value[order], second[order], owner[order]
        if len(value):
            new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
            value, second, owner = value[new], second[new], owner[new]
        n = np.bincount(owner, minlength=len(column))
        return value, second, np.cumsum(n) - n, n

    def registers(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows x registers, uint16. ``first`` lists the starts of the sets, none of them empty."""
        out = np.empty((len(first), len(self.factors)), dtype=np.uint16)
        if not len(first):
            return out
        for i, (f, s) in enumerate(zip(self.factors, self.shifts)):
            least = np.minimum.reduceat(value * f + s, first)
            h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
            out[:, i] = np.clip(np.floor(1.0 - np.log(np.maximum(h, 1e-300)) / math.log(B)), 0, Q + 1).astype(np.uint16)
        return out

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """Rows x bands, int64; the band's number is part of the key."""
        shape = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        keys = (shape * self.band_factors).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        return mix(keys).view(np.int64)


def likely(d_more: np.ndarray, d_less: np.ndarray, d_same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """False where the registers rule out a similarity of ``threshold`` or more.

    The three counts (registers larger in a, larger in b, equal) are multinomial with probabilities that depend on the similarity and the
    two set sizes. The best fit over all similarities is held against the best fit at or over the threshold.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    p = lambda x: -np.log(1 - np.maximum(x, 0) * (B - 1) / B) / math.log(B)

    def fit(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(u - v * j), 1e-6), np.maximum(p(v - u * j), 1e-6)
        return d_more * np.log(more) + d_less * np.log(less) + d_same * np.log(np.maximum(1 - more - less, 1e-6))

    low = np.max([fit(most * k / 40) for k in range(41)], axis=0)
    high = np.max([fit(threshold + (most - threshold) * k / 10) for k in range(11)], axis=0)
    return (most >= threshold) & (high >= np.maximum(low, high) - SURE)


def _sketched(docs: DataFrame, sketcher: Sketcher) -> DataFrame:
    """Per row of (d, t): d, n (set size), s1, s2 (hash of the set), th (hash of the text), bands."""

    def run(batches):
        a, b = constants(2, 31)
        for batch in batches:
            for part in in_pieces(batch, [], "t", size=4096, most=PART_CHARS):
                value, second, first, n = sketcher.sets(part.column("t"))
                full = n > 0
                keys = sketcher.band_keys(sketcher.registers(value, first[full]))
                sums = [np.zeros(len(n), dtype=np.int64) for _ in range(2)]
                for s, hashes, c in zip(sums, (value, second), (a, b)):
                    if len(value):
                        s[full] = np.add.reduceat(mix(hashes ^ c), first[full]).view(np.int64)
                ends = np.cumsum(np.where(full, sketcher.bands, 0))
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("th"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), bands], names=["d", "th", "n", "s1", "s2", "bands"])

    ship(docs.sparkSession)
    kind = docs.schema["d"].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("th", "n", "s1", "s2")]
    schema = T.StructType([T.StructField("d", kind), *longs, T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select("d", "t", F.xxhash64("t").alias("th")).mapInArrow(run, schema)


def _sets(texts: DataFrame, sketcher: Sketcher) -> DataFrame:
    """Per row of (id, t): id, n, set, regs."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, [], "t", size=4096, most=PART_CHARS):
                value, _, first, n = sketcher.sets(part.column("t"))
                keep = np.flatnonzero(n > 0)
                regs = sketcher.registers(value, first[keep])
                sets = pa.ListArray.from_arrays(pa.array(np.append(first[keep], len(value)), pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep)), pa.array(n[keep], pa.int64()), sets, pa.array([r.tobytes() for r in regs], pa.binary())], names=["id", "n", "set", "regs"])

    ship(texts.sparkSession)
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("set", T.ArrayType(T.LongType())), T.StructField("regs", T.BinaryType())])
    return texts.mapInArrow(run, schema)


class Verifier:
    """Turns candidate pairs (a, b) into links, by likelihood first and full sets last."""

    def __init__(self, scratch: Scratch, sets: DataFrame, percent: int):
        self.scratch, self.sets, self.percent = scratch, sets, percent

    def _fetch(self, pairs: DataFrame, side: str, column: str) -> DataFrame:
        other = "b" if side == "a" else "a"
        weights = self.scratch.keep(pairs.groupBy(side).agg(F.count("*").alias("w")), "weights")
        found = self.sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"{column}_{side}"))
        return salted_lookup(pairs, found, [side], weights, "w", [other])

    def links(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        def run(batches):
            for batch in batches:
                regs = [np.frombuffer(b"".join(batch.column(f"regs_{s}").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for s in "ab"]
                n = [batch.column(f"n_{s}").to_numpy().astype(np.float64) for s in "ab"]
                more, less = (regs[0] > regs[1]).sum(axis=1), (regs[0] < regs[1]).sum(axis=1)
                ok = likely(more, less, regs[0].shape[1] - more - less, *n, percent / 100)
                yield pa.RecordBatch.from_arrays([batch.column(s).filter(pa.array(ok)) for s in "ab"], names=["a", "b"])

        pairs = self.scratch.keep(pairs, "pairs")
        seen = self._fetch(self._fetch(pairs, "a", "regs"), "b", "regs")
        rows = seen.select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
        schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
        hopeful = self.scratch.keep(rows.mapInArrow(run, schema), "hopeful")
        full = self._fetch(self._fetch(hopeful, "a", "set"), "b", "set").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
        linked = full.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
        return self.scratch.keep(linked, "links")


def _joined(batches):
    """Per endpoint of the edges (a, b) of all ``batches``: x and p, one endpoint of its connected component."""
    up: dict = {}

    def root(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(*(batch.column(c).to_pylist() for c in "ab")):
            up[root(a)] = root(b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], names=["x", "p"])


def _renamed(scratch: Scratch, labels: DataFrame, parents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``labels`` (id, label) with each label that has a row in ``parents`` (x, p) changed to p, and the tables that this reads besides the two."""
    to = parents.select(F.col("x").alias("label"), "p")
    if labels.count() <= PLAIN_ROWS:
        named, read = labels.join(to, "label", "left"), []
    else:
        weights = scratch.keep(labels.groupBy("label").agg(F.count("*").alias("w")), "weights")
        named, read = salted_lookup(labels, to, ["label"], weights, "w", ["id"], how="left"), [weights]
    return named.select("id", F.coalesce("p", "label").alias("label")), read


def components(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """Per endpoint of ``edges`` (a, b): id and label, equal within a connected component; None without edges.

    Each round every node joins its smallest neighbour, in order of id and of a hash of it by turns (the first settles stars whose centre is the
    smallest, the second bounds the rounds on long chains), and edges are carried over to what their ends have joined. A star of many members is one key on
    the edges' side and then one label, so both are carried over by salted lookups; what each end weighs is counted along with its smallest neighbour.
    Rounds on a few edges cost their jobs alone, so the last ``FEW`` edges are joined in one task.
    """
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while size := edges.count():
        turn += 1
        before = [edges]
        if size <= FEW:
            ship(scratch.spark)
            schema = T.StructType([T.StructField(c, edges.schema["a"].dataType) for c in "xp"])
            parents = scratch.keep(edges.coalesce(1).mapInArrow(_joined, schema), "parents")
        else:
            rank = (lambda c: F.col(c)) if turn % 2 else (lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c)))
            one = F.lit(1).cast("long")
            both = edges.select("a", "b", one.alias("from_a")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (one - 1).alias("from_a")))
            best = both.groupBy(F.col("a").alias("x")).agg(F.min_by("b", rank("b")).alias("y"), F.sum("from_a").alias("w_a"), F.sum(1 - F.col("from_a")).alias("w_b"))
            parents = scratch.keep(best.select("x", F.when(rank("y") < rank("x"), F.col("y")).otherwise(F.col("x")).alias("p"), "w_a", "w_b"), "parents")
            moved = edges
            for end, other in (("a", "b"), ("b", "a")):
                to = parents.select(F.col("x").alias(end), F.col("p").alias(f"p_{end}"), f"w_{end}")
                moved = moved.join(to.drop(f"w_{end}"), end) if size <= PLAIN_ROWS else salted_lookup(moved, to.drop(f"w_{end}"), [end], to, f"w_{end}", [other])
            moved = moved.filter("p_a <> p_b").select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct()
            edges = scratch.keep(moved, "edges")
        before.append(parents)
        if labels is None:
            named = parents.select(F.col("x").alias("id"), F.col("p").alias("label"))
        else:
            named, read = _renamed(scratch, labels, parents)
            before += [labels, *read]
        labels = scratch.keep(named, "labels")
        scratch.drop(*before)
        if size <= FEW:
            return labels
    scratch.drop(edges)
    return labels


def extended(scratch: Scratch, labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """``components`` of the edges that gave ``labels`` and of ``edges`` (a, b, a written table) together: what is joined already counts as one node."""
    size = edges.count()
    if labels is None or not size:
        return components(scratch, edges) if labels is None else labels
    moved, read = edges, []
    for end, other in (("a", "b"), ("b", "a")):
        to = labels.select(F.col("id").alias(end), F.col("label").alias(f"p_{end}"))
        if size <= PLAIN_ROWS:
            moved = moved.join(to, end, "left")
        else:
            weights = scratch.keep(edges.groupBy(end).agg(F.count("*").alias("w")), "weights")
            moved, read = salted_lookup(moved, to, [end], weights, "w", [other], how="left"), [*read, weights]
    joined = components(scratch, moved.select(F.coalesce("p_a", "a").alias("a"), F.coalesce("p_b", "b").alias("b")))
    if joined is None:
        scratch.drop(*read)
        return labels
    named, more = _renamed(scratch, labels, joined.select(F.col("id").alias("x"), F.col("label").alias("p")))
    out = scratch.keep(named.unionByName(joined.join(labels.select("id"), "id", "left_anti")), "labels")  # a label is an id of ``labels`` too
    scratch.drop(labels, joined, *read, *more)
    return out


def _dealt(load: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a bucket's pairs, to meet on (band, salt): members outside the largest component, each in one of its bucket's ``salts``, and
    all members, repeated for each of them. So every pair meets once, and a hot bucket falls to as many tasks as it has salts."""
    salt = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("salts")).cast("int")
    return load.filter("label <> main").withColumn("salt", salt), load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _between(scratch: Scratch, members: DataFrame, labels: DataFrame | None, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that the first round left in different components.

    Only buckets with several components are opened, and there the members outside the largest one meet all others. The full sets travel with the
    bucket rows and are compared inside the join, so what comes out is links: no pair is written that is not one. A pair that shares several
    bands is compared in the first of them alone.
    """
    placed = members.select("band", "k", "id", "n")
    placed = placed.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")) if labels is not None else placed.withColumn("label", F.col("id"))
    placed = scratch.keep(placed, "placed")
    per_label = placed.groupBy("band", "label").agg(F.count("*").alias("m"))
    open_ = per_label.groupBy("band").agg(F.count("*").alias("labels"), F.sum("m").alias("w"), F.max_by("label", F.col("m")).alias("main"), F.max("m").alias("most")).filter("labels > 1")
    open_ = open_.withColumn("salts", F.ceil((F.col("w") - F.col("most")) / SPREAD).cast("int")).drop("most")
    open_ = scratch.keep(open_.drop("labels"), "open")
    split = scratch.keep(salted_lookup(placed, open_.drop("w"), ["band"], open_, "w", ["id"]), "split")
    load = split.join(sets.select("id", "set"), "id").join(heads.select("id", "bands"), "id")
    x, load = _dealt(load)
    x = x.select(*[F.col(c).alias(f"x_{c}") for c in ("band", "salt", "k", "id", "n", "label", "set", "bands")])
    n_x, n = F.col("x_n"), F.col("n")
    met = (F.col("label") != F.col("x_label")) & ((F.col("label") == F.col("main")) | (F.col("x_id") < F.col("id")))
    alike = 100 * F.least(n_x, n) >= percent * F.greatest(n_x, n)
    here = F.get(F.array_intersect("x_bands", "bands"), F.lit(0)) == F.col("band")
    both = F.size(F.array_intersect("x_set", "set"))
    linked = (100 + percent) * both >= percent * (n_x + n)  # 100 * both >= percent * (n_x + n - both), with one intersection: a join's condition takes what it names twice twice
    found = x.join(load, (F.col("x_band") == F.col("band")) & (F.col("x_salt") == F.col("salt")) & met & alike & F.when(here, linked).otherwise(False))
    return scratch.keep(found.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")), "between")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links) and kept (id = component_id).

    Linked: 100 * |intersection| >= ``percent`` * |union| of the distinct word shingles. Words are separated by ASCII white space, A-Z lower-cased.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing. A text of fewer words than a shingle is one shingle.
    Rows of one id are one document; if their texts differ, the smallest shingle set (by size and hash) is linked for it. A row with a
    null id has a null component and is kept. Repeated rows are all returned. Other columns are ignored. An empty table gives an empty table.
    """
    spark, scratch, sketcher = docs.sparkSession, Scratch(docs.sparkSession), Sketcher(shingle)
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    key = ["n", "s1", "s2"]
    sketched = scratch.keep(_sketched(texts, sketcher), "sketched")
    usable = sketched.filter("d is not null and n > 0")
    classes = scratch.keep(usable.groupBy(*key).agg(F.min("d").alias("id"), F.count("*").alias("w")), "classes")
    chosen = classes.groupBy("id").agg(F.min(F.struct(*key)).alias("k")).select("id", *[f"k.{c}" for c in key])
    heads = usable.join(chosen.withColumnRenamed("id", "d"), ["d", *key]).dropDuplicates(["d"]).select(F.col("d").alias("id"), "th", "n", "bands")
    heads = scratch.keep(heads, "heads")
    banded = heads.select("id", "n", F.posexplode("bands").alias("k", "band"))
    order = F.xxhash64("id", F.pmod("band", F.lit(3)))
    buckets = banded.groupBy("band").agg(F.count("*").alias("w"), F.min_by("id", order).alias("lead"), F.min_by("n", order).alias("lead_n")).filter("w > 1")
    buckets = scratch.keep(buckets, "buckets")
    members = scratch.keep(salted_lookup(banded, buckets.drop("w"), ["band"], buckets, "w", ["id"]), "members")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = members.filter((F.col("id") != F.col("lead")) & alike("n", "lead_n")).select(*pair("id", "lead")).distinct()
    wanted = members.groupBy("id").agg(F.count("*").alias("m")).join(heads.select("id", "th"), "id")
    once = Window.partitionBy("d", "th").orderBy(F.lit(0))
    found = texts.withColumn("th", F.xxhash64("t")).join(wanted.select(F.col("id").alias("d"), "th"), ["d", "th"]).withColumn("k", F.row_number().over(once)).filter("k = 1")
    sets = scratch.keep(_sets(found.select(F.col("d").alias("id"), "t"), sketcher), "sets")
    verifier = Verifier(scratch, sets, percent)
    links = verifier.links(stars)
    labels = components(scratch, links)
    more = _between(scratch, members, labels, heads, sets, percent)
    labels = extended(scratch, labels, more)
    grouped = classes
    if labels is not None:
        smallest = labels.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("w"))
        smallest = scratch.keep(smallest, "smallest")
        named = salted_lookup(labels, smallest.drop("w"), ["label"], smallest, "w", ["id"]).select("id", "component")
        grouped = classes.join(named, "id", "left")
    grouped = scratch.keep(grouped.select(*key, "w", (F.coalesce("component", "id") if labels is not None else F.col("id")).alias("component")), "grouped")
    linked = salted_lookup(usable.select("d", "th", *key), grouped.drop("w"), key, grouped, "w", ["d"])
    scratch.only(sketched, grouped)
    alone = sketched.filter("d is null or n = 0").select("d", "n", F.col("d").alias("component"))
    out = linked.select("d", "n", "component").unionByName(alone)
    return out.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("d") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Defined cases: those of ``near_groups``; rows with a null id stay, as do all rows of a kept id. Columns pass through whatever their names.
    """
    kept = near_groups(docs, id_col, text_col, shingle, percent).filter(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")[id_col]
    found = rows.filter(own.isNotNull()).join(kept, own == F.col("kept"), "left_semi").unionByName(rows.filter(own.isNull()))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)


SQL = """
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words),
sized as (select doc_id, len(s)::bigint as n, s from shingles),
flat as (select doc_id, n, unnest(s) as g from sized),
rare as (select g from flat group by g having count(*) >= 2),
shared as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared_n from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) where a.g in (select g from rare) group by all),
links as (select a, b from shared where 100 * shared_n >= 80 * (na + nb - shared_n) union all select b, a from shared where 100 * shared_n >= 80 * (na + nb - shared_n)),
reach as (with recursive r(doc_id, c) as (select doc_id, doc_id from sized union select l.b, r.c from r join links l on l.a = r.doc_id) select doc_id, min(c) as component_id from r group by doc_id)
select s.doc_id, s.n as n_shingles, r.component_id, s.doc_id = r.component_id as kept from sized s join reach r on s.doc_id = r.doc_id
"""
