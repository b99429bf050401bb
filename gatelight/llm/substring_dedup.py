"""Substring dedup by level-wise doubling.

Windows that repeat across documents are found at a short length first, and only those are extended to (at most) twice that length, until
the wanted length is reached or no candidate survives. A window of the wanted length contains windows of the level's length; of these the
one with the smallest hash is its seed at that level. Equal windows have equal seeds, so a window whose seed occurs in no
other document cannot repeat and is not looked at again; seeds are about a quarter of the words.

At the wanted length, neighbouring candidate windows with one seed are first compared as a stretch (up to twice as long as one window). A stretch
that an earlier document holds whole settles all its windows at once. The first holder of a stretch is the only one whose windows are then
compared singly: the first document with a window is also the first with the stretch around it, so no earlier holder is overlooked.

Skew: what repeats is found by an aggregate (smallest and largest id per hash), which combines before its shuffle, and carried back to the
rows by a salted lookup, so a very common passage never gathers in one task. Stretches and windows are compared by 128 bits, from the words up: each
half is made of word hashes of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, salted_lookup, ship
from .hashing import buffers, constants, mix, window_hashes, word_hashes
from .tokens import in_pieces

WORDS = 13
FIRST = 7
PART_BYTES = 4_000_000
SEEDS = 41  # picks the constants of the windows' hashes


def levels(words: int, first: int) -> list[int]:
    """Window lengths from ``first`` to ``words``, none over twice the one before."""
    out = [min(first, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


def seeds(windows: np.ndarray, at: np.ndarray, rows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each long window, index into ``windows`` of its seed); ``span`` short windows make one long window."""
    n = len(windows) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero((at[span - 1 :] - at[:n] == span - 1) & (rows[at[:n]] == rows[at[span - 1 :]]))
    best = whole.copy()
    for k in range(1, span):
        better = windows[whole + k] < windows[best]  # ties stay with the leftmost
        best[better] = (whole + k)[better]
    return at[whole], best


def seed_runs(words: np.ndarray, rows: np.ndarray, length: int, size: int, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first start, number of starts) of the runs of neighbouring ``size``-word windows that share a seed of ``length`` words.

    ``live``, if given, marks the words at which a window that is still a candidate starts; others are left out.
    """
    value, at = window_hashes(words, rows, length, SEEDS)
    starts, best = seeds(value, at, rows, size - length + 1)
    if live is not None:
        open_ = live[starts]
        starts, best = starts[open_], best[open_]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return value[best[new]], starts[new], np.diff(np.append(new, len(starts)))


def hashes_at(both: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``size`` words that start at ``at``; ``both``: the two hashes of each word."""
    out = []
    for words, family in zip(both, (SEEDS + 1, SEEDS + 2)):
        value = np.zeros(len(at), dtype=np.uint64)
        for k, c in enumerate(constants(size, family)):
            value += words[at + k] * c
        out.append(mix(value))
    return out[0], out[1]


def _words(column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(the two hashes of each word, row of each word, first word of each row)."""
    data, offsets = buffers(column)
    first, second, rows, _ = word_hashes(data, offsets, lower=False)
    return (first, second), rows, np.searchsorted(rows, np.arange(len(column)))


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first position, number of positions) of the runs of a list column."""
    import pyarrow.compute as pc

    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), many), flat.field("p").to_numpy(), flat.field("n").to_numpy()


def _marked(column: pa.Array, first: np.ndarray, n: int) -> np.ndarray:
    """Flags of the ``n`` words at which a run of the list column has a start."""
    edge = np.zeros(n + 1, dtype=np.int32)
    row, p, many = _runs(column)
    np.add.at(edge, first[row] + p, 1)
    np.add.at(edge, first[row] + p + many, -1)
    return np.cumsum(edge)[:-1] > 0


def _scanned(texts: DataFrame, keys: list[str], work) -> DataFrame:
    """Rows (keys, d, th, p, n): ``work(part, words, rows, first)`` gives key arrays, first words and lengths of runs for a part of ``texts`` (d, th, t, ...)."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, [], "t", size=1 << 20, most=PART_BYTES):
                words, rows, first = _words(part.column("t"))
                found, at, n = work(part, words, rows, first)
                row = rows[at]
                owner = pa.array(row)
                columns = [*[pa.array(h.view(np.int64)) for h in found], part.column("d").take(owner), part.column("th").take(owner)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((at - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=[*keys, "d", "th", "p", "n"])

    ship(texts.sparkSession)
    fields = [T.StructField(k, T.LongType()) for k in keys] + [texts.schema["d"], texts.schema["th"]]
    return texts.mapInArrow(run, T.StructType([*fields, T.StructField("p", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def _repeated(scratch: Scratch, rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys that several documents hold, with the smallest id (``lo``) and the number of rows (``w``); None if there are none."""
    ends = rows.groupBy(*keys).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("w"))
    shared = scratch.keep(ends.filter("lo < hi").drop("hi"), "shared")
    return None if shared.isEmpty() else shared


def _lookup(rows: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    return salted_lookup(rows, shared.drop("w"), keys, shared, "w", ["d", "p"]).select("d", "th", "p", "n", "lo")


def _per_text(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """Runs (p, n) gathered per text (d, th)."""
    return scratch.keep(rows.groupBy("d", "th").agg(F.collect_list(F.struct("p", "n")).alias(name)), name)


def repeats(scratch: Scratch, texts: DataFrame, words: int = WORDS, first: int = FIRST) -> DataFrame | None:
    """Written table of runs of starts of ``words``-word windows that also start in a smaller document, per text of ``texts`` (d, th, t): d, th, runs.

    None if no window repeats. ``th`` tells texts of one id apart.
    """
    lengths = levels(words, first)
    live: DataFrame | None = None
    for length in lengths[:-1] or lengths:
        source = texts if live is None else texts.join(live, ["d", "th"])

        def candidates(part, w, rows, start, length=length, later=live is not None):
            alive = _marked(part.column("live"), start, len(w[0])) if later else None
            h, at, n = seed_runs(w[0], rows, length, words, alive)
            return (h,), at, n

        found = _scanned(source, ["h"], candidates)
        if live is not None:  # behind a join of the texts: written, not made twice
            found = scratch.keep(found, "seeds")
        shared = _repeated(scratch, found, ["h"])
        if shared is None:
            return None  # no candidate survives
        before, live = live, _per_text(scratch, _lookup(found, shared, ["h"]), "live")
        scratch.drop(shared, *([before, found] if before is not None else []))
    length, keys = (lengths[:-1] or lengths)[-1], ["h1", "h2"]

    def stretches(part, w, rows, start):
        _, at, n = seed_runs(w[0], rows, length, words, _marked(part.column("live"), start, len(w[0])))
        (a1, a2), (b1, b2) = hashes_at(w, at, words), hashes_at(w, at + n - 1, words)
        many, (c1, c2) = n.astype(np.uint64), constants(2, SEEDS + 3)
        return (mix(a1 * c1 + b1 + many), mix(a2 * c2 + b2 + many)), at, n

    found = scratch.keep(_scanned(texts.join(live, ["d", "th"]), keys, stretches), "stretches")
    shared = _repeated(scratch, found, keys)
    settled = None
    if shared is not None:
        settled = _per_text(scratch, _lookup(found, shared, keys).filter("d > lo"), "settled")
        scratch.drop(shared)
    scratch.drop(found)
    left = live.join(settled, ["d", "th"], "left") if settled is not None else live

    def single(part, w, rows, start, some=settled is not None):
        open_ = _marked(part.column("live"), start, len(w[0]))
        if some:
            open_ &= ~_marked(part.column("settled"), start, len(w[0]))
        at = np.flatnonzero(open_)
        return hashes_at(w, at, words), at, np.ones(len(at), dtype=np.int32)

    found = scratch.keep(_scanned(texts.join(left, ["d", "th"]), keys, single), "windows")
    shared = _repeated(scratch, found, keys)
    parts = [] if settled is None else [settled.select("d", "th", F.explode("settled").alias("r")).select("d", "th", "r.p", "r.n")]
    if shared is not None:
        parts.append(_lookup(found, shared, keys).filter("d > lo").select("d", "th", "p", "n"))
    out = None
    if parts:
        out = _per_text(scratch, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "runs")
    scratch.drop(live, found, *[t for t in (shared, settled) if t is not None])
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, first: int = FIRST) -> DataFrame:
    """``docs`` with ``text_col`` cut to the kept words (joined by one blank), plus n_words and n_removed; these win over like-named columns.

    A word goes if a window of ``words`` consecutive words covers it whose sequence also starts in a document with a smaller id. Windows are judged
    on the input. Words are separated by ASCII white space and compared as they are.

    Defined cases: a null, empty or blank text has no words and gives an empty text. Rows of one id are one document and never remove each other's
    words, whether their texts are equal or not. A row with a null id takes no part: it keeps its words. A text shorter than a window keeps its
    words. Repeated rows are all returned. Other columns pass through, whatever their names. An empty table gives an empty table.
    """
    scratch, text = Scratch(docs.sparkSession), F.coalesce(text_col, F.lit(""))
    key = (F.col(id_col).alias("d"), F.xxhash64(text).alias("th"), text.alias("t"))
    found = repeats(scratch, docs.filter(F.col(id_col).isNotNull()).select(*key), words, first)
    own = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    names = [f"c{i}" for i in range(len(own))]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, names)], *key)
    none = F.lit(None).cast("array<struct<p:int,n:int>>").alias("runs")
    joined = flat.join(found, ["d", "th"], "left") if found is not None else flat.withColumn("runs", none)

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, [], "t", size=4096, most=PART_BYTES):
                kept, total, gone = [], [], []
                owner, first, many = _runs(part.column("runs"))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i, text in enumerate(part.column("t").to_pylist()):
                    lo, hi = bounds[i], bounds[i + 1]
                    parts = text.encode("utf-8", "surrogatepass").split()
                    total.append(len(parts))
                    if lo < hi:
                        edge = np.zeros(len(parts) + words + 1, dtype=np.int32)
                        np.add.at(edge, first[lo:hi], 1)
                        np.add.at(edge, first[lo:hi] + many[lo:hi] + words - 1, -1)
                        parts = [parts[i] for i in np.flatnonzero(np.cumsum(edge)[: len(parts)] == 0)]
                    gone.append(total[-1] - len(parts))
                    kept.append(b" ".join(parts))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], text, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "t", "n_words", "n_removed"])

    ship(docs.sparkSession)
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in zip(own, names)], T.StructField("t", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.select(*names, "t", "runs").mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(own, names)], F.col("t").alias(text_col), "n_words", "n_removed")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13) s),
firsts as (select doc_id, i, min(doc_id) over (partition by g) < doc_id as again from windows),
spots as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
judged as (select doc_id, word, i, coalesce(bool_or(again) over (partition by doc_id order by i rows between 12 preceding and current row), false) as gone
  from spots left join firsts using (doc_id, i)),
kept as (select doc_id, count(*) as n, count(*) filter (where gone) as m, string_agg(word, ' ' order by i) filter (where not gone) as t from judged group by doc_id)
select w.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(m, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words w left join kept k on w.doc_id = k.doc_id
"""
