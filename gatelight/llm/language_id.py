"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams in order of frequency. A document's own list is compared with each
profile by the out-of-place distance: for each of its n-grams, how far its rank is from the profile's rank, or the
largest distance if the profile lacks it. The nearest profile wins.

N-grams are runs of 1 to 3 lower-case letters inside words, with one blank at either end of a word. Counting is done on whole texts in
numpy over Arrow batches.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ship
from .tokens import in_pieces

SIZES = (1, 2, 3)
DOC_GRAMS = 300
PROFILE_GRAMS = 400
#: Labelled documents learnt from, per language, on average: a fixed hash of the id picks them. Languages with fewer give all.
SAMPLE_DOCS = 20_000
UNKNOWN = "und"
#: Rows handled together: row, n-gram length and three 16-bit letters then share one 64-bit sort key.
ROWS = 256
CHARS = 1 << 19  # characters whose n-grams are counted at a time; their arrays take about 100 bytes a character
BLANK = 1


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point 0 if it is no letter, else a 16-bit code of its lower-case form (rarer planes are folded into it)."""
    table = np.zeros(0x110000, dtype=np.uint16)
    for c in range(0x34000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            low = ord(low) if len(low) == 1 else c
            table[c] = low if low < 0x10000 else 2 + low % 0xFFF0
    return table


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram code, count) of up to ``ROWS`` texts, sorted by row, then count descending, then code."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    lengths = np.array([len(c) + 2 for c in codes], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    letters = np.zeros(int(lengths.sum()), dtype=np.uint16)
    table = letter_table()
    for s, c in zip(starts, codes):
        letters[s + 1 : s + 1 + len(c)] = table[c]
    is_letter = letters > 0
    edge = ~is_letter
    edge[1:-1] &= is_letter[:-2] | is_letter[2:]
    letters[edge] = BLANK  # the place before or after a word
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << 50, lengths)
    some, inner = letters > 0, letters > BLANK
    chars, keys = letters.astype(np.int64), []
    for n in SIZES:
        if len(chars) < n:
            break
        m = len(chars) - n + 1
        fine = inner[:m].copy() if n == 1 else some[:m] & some[n - 1 :]
        for k in range(1, n - 1):
            fine &= inner[k : m + k]
        if n == 2:
            fine &= inner[:m] | inner[1:]
        at = np.flatnonzero(fine)
        code = chars[at]
        for k in range(1, n):
            code = (code << 16) | chars[at + k]
        keys.append(row[at] | (n << 48) | code)
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    owner = key >> 50
    if len(key) < 1 << 27 and count.max(initial=0) < 1 << 28:
        order = np.sort((owner << 55) | (((1 << 28) - 1 - count) << 27) | np.arange(len(key))) & ((1 << 27) - 1)
    else:
        order = np.lexsort((key, -count, owner))
    return owner[order], key[order] & ((1 << 50) - 1), count[order]


def gram_counts(docs: DataFrame) -> DataFrame:
    """Total count of each n-gram per language over all rows of ``docs`` (t, lang): one row per batch, language and n-gram before the sum."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            offset, parts = 0, []
            for part in in_pieces(batch, ["lang"], "t", ROWS, CHARS):
                owner, key, count = grams_of(part.column("t").to_pylist())
                which = np.array([place[x] for x in langs[offset : offset + part.num_rows]], dtype=np.int64)
                offset += part.num_rows
                parts.append(pd.DataFrame({"l": which[owner], "g": key.astype(np.int64), "n": count}).groupby(["l", "g"], as_index=False)["n"].sum())
            if parts:
                whole = pd.concat(parts).groupby(["l", "g"], as_index=False)["n"].sum()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in whole["l"]], pa.string()), pa.array(whole["g"], pa.int64()), pa.array(whole["n"], pa.int64())], names=["lang", "g", "n"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", grams: int = PROFILE_GRAMS, sample: int = SAMPLE_DOCS) -> dict[str, list[int]]:
    """Profiles by language: its ``grams`` most frequent n-grams, most frequent first, ties by code.

    Learnt from about ``sample`` documents per language, taken by a hash of their ids (all documents of smaller languages).
    What reaches the driver is ``grams`` codes per language: languages, not documents, decide its size.

    Defined cases: rows with a null text or language teach nothing; a text without letters has no n-gram. Whole texts count, of any length. Rows of
    one id, or of a null one, are drawn together or not at all; repeated rows count each. Without usable rows there is no profile. A
    language that is given but has no letter in any of its drawn texts has none either. Other columns are ignored.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 20)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    large = {lang: math.ceil((1 << 20) * sample / n) for lang, n in sizes.items() if n > sample}
    if large:
        limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(cut)) for lang, cut in sorted(large.items())], F.lit(1 << 20))
        rows = rows.filter(F.col("draw") < limit)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    top = gram_counts(rows.select("t", "lang")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= grams)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["g"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(found.items())}


def nearest(texts: list[str | None], codes: np.ndarray, ranks: np.ndarray, names: list[str], doc_grams: int, penalty: int) -> tuple[list[str], list[float]]:
    """Language and score of each text. ``codes`` sorted, ``ranks`` per code and language (``penalty`` where a profile lacks it)."""
    owner, key, _ = grams_of(texts)
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < doc_grams
    owner, key, rank = owner[top], key[top].astype(np.int64), rank[top]
    used = np.bincount(owner, minlength=len(texts))
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not names or not len(owner):
        return labels, scores
    at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
    known = codes[at] == key
    place = ranks[at]
    away = np.where(known[:, None] & (place < penalty), np.minimum(np.abs(place - rank[:, None]), penalty), penalty)
    total = np.zeros((len(texts), len(names)))
    full = np.flatnonzero(used)
    total[full] = np.add.reduceat(away, np.searchsorted(owner, full), axis=0)
    for i in np.flatnonzero(used):
        best = int(np.argmin(total[i]))  # names are sorted: ties go to the first
        labels[i] = names[best]
        scores[i] = 1.0 - float(total[i, best]) / (penalty * int(used[i]))
    return labels, scores


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", doc_grams: int = DOC_GRAMS, keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``), plus lang_pred and score (0 to 1; 1 is a perfect match of ranks); these win over like-named columns.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is any text when there is no profile. Ties go to the
    language first by code point. Repeated rows get equal results. An empty table gives an empty table. Whole texts are counted.
    """
    names = sorted(profiles)
    penalty = max([len(p) for p in profiles.values()], default=1)
    codes = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
    ranks = np.full((max(len(codes), 1), max(len(names), 1)), penalty, dtype=np.int64)
    for j, name in enumerate(names):
        ranks[np.searchsorted(codes, np.array(profiles[name], dtype=np.int64)), j] = np.arange(len(profiles[name]))
    own = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    flat_names = ["t" if c == text_col else f"c{i}" for i, c in enumerate(own)]

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, own, "t", ROWS, CHARS):
                labels, scores = nearest(part.column("t").to_pylist(), codes, ranks, names, doc_grams, penalty)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in flat_names], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*flat_names, "lang_pred", "score"])

    ship(docs.sparkSession)
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(flat_names, own)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(flat_names, own) if c != text_col], F.col(text_col).alias("t"))
    return flat.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(flat_names, own)], "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: CRC-32 of the id as text leaves 2 on division by 4. Rows with a null id are learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles)
