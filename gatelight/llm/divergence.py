"""Audit of how far the sources of a language differ in their words, over an exact vocabulary, in two passes over the texts.

First pass: in how many documents of its language does a term stand? Tasks count distinct terms per document in bounded tables, Spark adds them
up, and terms of enough documents are kept. Second pass: an Aho-Corasick automaton of the kept terms, each between two delimiters,
goes over the whole texts (every gap between words made one delimiter) and counts occurrences by language and source. The vocabulary reaches the tasks
in blocks of bounded size, dealt by hash; a vocabulary of several blocks takes as many passes, so neither the driver nor a task ever holds more
than a block.

Only occurrences that exist are posted (language, source, term, count). The divergence of two sources sums |p - q| over all kept terms; a term
that neither posts adds the same amount each time, one that only the first posts adds |p - q0| with q0 the second's share of an absent
term. So the sum is: what each source's postings would add were the other empty there (from its postings counted by p), a constant
for what neither posts, and a correction for terms that both post. The corrections come from blocks of terms, each task giving one row per pair of sources
that meet there. Shares are whole numbers, and so are all sums.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship
from .tokens import in_pieces

MIN_DOCS = 30  # documents of a language that a kept term stands in
SMOOTH = 5  # added to each count
SCALE = 1_000_000_000
TOP = 50  # ranks of the terms' part
BLOCK_TERMS = 250_000  # kept terms that one automaton and one broadcast hold, about
TABLE_TERMS = 400_000  # entries of a task's table of counts before it is handed on
BLOCK_POSTINGS = 200_000  # postings that one task compares at once, about
PAIRED = 200  # sources of a language that one task sets against all others, about
PART_BYTES = 8_000_000

#: What separates terms becomes a blank and A-Z lower case; UTF-8 bytes over 0x7F belong to terms and stay.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _flat(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(empty(text_col).alias("t"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))


def _texts(part: pa.RecordBatch):
    """(columns other than the text as lists, texts as bytes with blanks between terms) of a piece of a batch."""
    rest = {c: part.column(c).to_pylist() for c in part.schema.names if c != "t"}
    return rest, [b.translate(_PLAIN) for b in part.column("t").cast(pa.large_binary()).to_pylist()]


def _term_batches(counted: dict[tuple[str, ...], Counter], names: tuple[str, ...], value: str):
    """Record batches (keys, term, count) of counts by key; terms are bytes or text."""
    for key, counter in counted.items():
        if not counter:
            continue
        terms = pa.array(counter.keys(), pa.binary() if isinstance(next(iter(counter)), bytes) else pa.string()).cast(pa.string())
        keys = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int32)), pa.array([k])).cast(pa.string()) for k in key]
        yield pa.RecordBatch.from_arrays([*keys, terms, pa.array(counter.values(), pa.int64())], names=[*names, "term", value])


def vocabulary(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, df of the terms that stand in at least ``min_docs`` rows of ``texts`` (t, lang) of their language."""

    def run(batches):
        tables: dict[tuple[str], Counter] = {}
        for batch in batches:
            for part in in_pieces(batch, [], "t", size=4096, most=PART_BYTES):
                rest, plain = _texts(part)
                for lang, text in zip(rest["lang"], plain):
                    terms = set(text.split())
                    if terms:
                        tables.setdefault((lang,), Counter()).update(terms)
                if sum(map(len, tables.values())) > TABLE_TERMS:
                    yield from _term_batches(tables, ("lang",), "df")
                    tables = {}
        yield from _term_batches(tables, ("lang",), "df")

    ship(texts.sparkSession)
    counted = texts.select("t", "lang").mapInArrow(run, "lang string, term string, df long")
    return counted.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_docs)


_AUTOMATA: dict[str, dict] = {}


def _automata(name: str, terms: dict[str, list[str]]) -> dict:
    """Automata by language of a block, kept by the worker until another block comes."""
    import ahocorasick

    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        built = {}
        for lang, kept in terms.items():
            built[lang] = ahocorasick.Automaton()
            for term in kept:
                built[lang].add_word(f" {term} ", term)
            built[lang].make_automaton()
        _AUTOMATA[name] = built
    return _AUTOMATA[name]


def occurrences(scratch: Scratch, texts: DataFrame, kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Written table of the occurrences (lang, source, term, n) of ``kept`` terms (lang, term) in ``texts`` (t, lang, source).

    Terms are matched between delimiters, so a term within a longer one does not count; two neighbours share their delimiter, as the automaton
    reports overlapping matches.
    """
    spark, kind = texts.sparkSession, "lang string, source string, term string, n long"
    ship(spark)
    blocks = math.ceil(kept.count() / block_terms)
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks or 1)))
    out = spark.createDataFrame([], kind)
    for b in range(blocks):
        terms: dict[str, list[str]] = {}
        for row in dealt.filter(F.col("block") == b).select("lang", "term").toLocalIterator():  # about block_terms rows
            terms.setdefault(row.lang, []).append(row.term)
        sent, name = spark.sparkContext.broadcast(terms), f"{scratch.root}/{b}"

        def run(batches, sent=sent, name=name):
            tables: dict[tuple[str, str], Counter] = {}
            for batch in batches:
                automata = _automata(name, sent.value)
                for part in in_pieces(batch, [], "t", size=4096, most=PART_BYTES):
                    rest, plain = _texts(part)
                    for lang, source, text in zip(rest["lang"], rest["source"], plain):
                        if lang in automata:
                            body = f" {b' '.join(text.split()).decode()} "
                            tables.setdefault((lang, source), Counter()).update(map(itemgetter(1), automata[lang].iter(body)))
                    if sum(map(len, tables.values())) > TABLE_TERMS:
                        yield from _term_batches(tables, ("lang", "source"), "n")
                        tables = {}
            yield from _term_batches(tables, ("lang", "source"), "n")

        found = texts.mapInArrow(run, kind).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        out = out.unionByName(scratch.keep(found, "counts")) if b else scratch.keep(found, "counts")
        sent.unpersist()
    return out


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * size)), exactly, whatever the counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = wide(F.lit(SCALE)) * wide(count + SMOOTH)
    below = wide(total) + wide(F.lit(SMOOTH)) * wide(size)
    return F.when(size > 0, F.call_function("div", top, below) + 1)


def shared_postings(frame: pd.DataFrame) -> pd.DataFrame:
    """Per pair of sources (source < other) that post a term of this block both: n, the number of such terms, and what they change.

    ``frame``: postings (source, term, p, p0) of a block. A term of both counts |p - q| in place of |p - q0| + |q - p0|.
    """
    frame = frame.sort_values(["source", "term"])
    term, (source, names) = pd.factorize(frame["term"])[0], pd.factorize(frame["source"])
    p, p0 = frame["p"].to_numpy(np.int64), frame["p0"].to_numpy(np.int64)
    starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
    ends = np.append(starts[1:], len(source))
    own, has = np.zeros(term.max() + 1, dtype=np.int64), np.zeros(term.max() + 1, dtype=bool)
    rows = []
    for g in range(len(starts) - 1):
        mine, rest = slice(starts[g], ends[g]), slice(ends[g], None)
        own[term[mine]], has[term[mine]] = p[mine], True
        t, q = term[rest], p[rest]
        both = has[t]
        change = np.where(both, np.abs(own[t] - q) - np.abs(own[t] - p0[rest]) - np.abs(q - p0[starts[g]]), 0)
        at = starts[g + 1 :] - ends[g]
        n, change = np.add.reduceat(both.astype(np.int64), at), np.add.reduceat(change, at)
        met = np.flatnonzero(n)
        rows.append((np.full(len(met), g), g + 1 + met, n[met], change[met]))
        has[term[mine]] = False
    if not rows:
        return pd.DataFrame({"source": [], "other": [], "n": [], "change": []})
    a, b, n, change = (np.concatenate(x) for x in zip(*rows))
    return pd.DataFrame({"source": names[a], "other": names[b], "n": n, "change": change})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other (part ``pair``) and the terms that set it apart (``term``).

    Terms are runs of letters A-Z (lower-cased) and non-ASCII characters. A language keeps the terms of at least ``min_docs`` of its documents. With count
    occurrences of a kept term in a group, N of all, and V kept terms: p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)). Part ``pair``: for each other
    source of the language the sum of |p - q| over all kept terms, all ranks. Part ``term``: |p - q| against the language's q, for terms
    the source has and has more of, to rank ``top``. Ranks follow value (largest first), then item.

    Defined cases: a null text, language or source counts as ''. A group without terms, or a language without kept terms, still is compared: sums over
    no terms are 0. A source alone in its language has no pair. Repeated rows count each. Other columns are ignored. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _flat(docs, text_col, lang_col, source_col)
    kept = scratch.keep(vocabulary(texts, min_docs), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    counts = occurrences(scratch, texts, kept, block_terms)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # the groups of all documents, with what each posts: one row per language and source
    present = texts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    posted = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("posts"))
    groups = present.join(posted, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total"), zero("posts"), zero("v"))
    groups = scratch.keep(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    posts = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    posts = scratch.keep(posts, "posts")
    scratch.drop(kept)
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    base = by_term.join(whole, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    # terms: more than the language has; the rank limit acts before the shuffle already
    above = posts.join(base, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # pairs: what both post, block by block of terms
    n_blocks = max(1, math.ceil(posts.count() / BLOCK_POSTINGS))
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int")
    ship(docs.sparkSession)

    def meet(key, frame):
        out = shared_postings(frame)
        out.insert(0, "lang", key[0])
        return out

    met = posts.select("lang", block.alias("block"), "source", "term", "p", "p0").groupBy("lang", "block").applyInPandas(meet, "lang string, source string, other string, n long, change long")
    met = met.groupBy("lang", "source", "other").agg(F.sum("n").alias("n"), F.sum("change").alias("change"))
    mirrored = F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))
    met = met.select("lang", mirrored.alias("s"), "n", "change").select("lang", "s.source", "s.other", "n", "change")
    # each group's postings by p, so that the share of an absent term can be held against all of them
    levels = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("levels"))
    sides = scratch.keep(groups.join(levels, ["lang", "source"], "left").select("lang", "source", "posts", "v", "p0", F.coalesce("levels", F.array().cast("array<struct<p:bigint,m:bigint>>")).alias("levels")), "sides")
    per_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("salts"))
    sides = sides.join(per_lang, "lang")
    other = sides.select("lang", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"o_{c}") for c in ("source", "posts", "p0", "levels")])
    sides = sides.withColumn("salt", F.pmod(F.xxhash64("source"), F.col("salts")).cast("int"))
    against = lambda levels, p0: F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + x["m"] * F.abs(x["p"] - F.col(p0)))
    pairs = sides.join(other, ["lang", "salt"]).filter(F.col("source") != F.col("o_source"))
    pairs = pairs.join(met.withColumnRenamed("other", "o_source"), ["lang", "source", "o_source"], "left")
    n, change = F.coalesce("n", F.lit(0)), F.coalesce("change", F.lit(0))
    neither = (F.col("v") - F.col("posts") - F.col("o_posts") + n) * F.abs(F.col("p0") - F.col("o_p0"))
    value = F.coalesce(against(F.col("levels"), "o_p0") + against(F.col("o_levels"), "p0") + change + neither, F.lit(0)).cast("long")
    pairs = pairs.select("lang", "source", F.col("o_source").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(order))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = """
with docs as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
spots as (select k, lang, source, unnest(w) as term from docs),
kept as (select lang, term from spots group by lang, term having count(distinct k) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
occurring as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from spots join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from occurring g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from cells join sizes using (lang)),
lang_cells as (select lang, term, sum(n)::bigint as n from cells group by lang, term),
lang_shares as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from lang_cells join sizes using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from occurring a join occurring b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from shares join lang_shares using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms) x)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
