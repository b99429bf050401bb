"""Line dedup: lines that many documents share are dropped everywhere but in one document.

Native: explode normalised lines, hash them, count distinct documents per hash, drop lines over the threshold and put the
text together again by line position. Lines travel as 128-bit hashes and positions; the text itself moves once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, hash128, salted_lookup

MIN_DOCS = 3
MIN_CHARS = 20


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` replaced by the kept lines, plus ``n_lines`` and ``n_dropped`` (these win over like-named columns).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents keep their lines only in the document with the largest id.

    Defined cases: a null or empty text is one empty line (and comes back as an empty text). Rows of equal id count as one
    document; rows with a null id count together as one document, smaller than all others. Repeated rows are all returned and get
    equal results. Other columns pass through whatever their names. An empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("d"), text.alias("t"))
    lines = base.select("d", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    keyed = lines.select("d", "th", "pos", key.alias("k")).filter(F.length("k") >= min_chars)
    h1, h2 = hash128(F.col("k"))
    keyed = keyed.select("d", "th", "pos", h1.alias("h1"), h2.alias("h2"))
    shared = keyed.groupBy("h1", "h2", "d").agg(F.count("*").alias("m")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("m").alias("w"), F.max("d").alias("keeper"))
    shared = scratch.keep(shared.filter(F.col("n") >= min_docs).drop("n"), "shared")
    hits = salted_lookup(keyed, shared.drop("w"), ["h1", "h2"], shared, "w", ["d", "pos"]).filter(~F.col("d").eqNullSafe(F.col("keeper")))
    dropped = hits.groupBy("d", "th").agg(F.collect_set("pos").alias("gone")).select(F.col("d").alias("_d"), F.col("th").alias("_th"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("d"), text.alias("t"), F.xxhash64(text).alias("th"))
    joined = rows.join(dropped, F.col("d").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")), "left").select("row", "gone", "t", F.split("t", "\n").alias("all"))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(places, lambda p: F.col("all")[p]), "\n"))
    out = joined.select("row", kept.alias("t"), F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    n_dropped = F.when(F.col("n_gone") > 0, F.col("n_gone")).otherwise(F.lit(0)).cast("long")
    return out.select(*rest, F.col("t").alias(text_col), "n_lines", n_dropped.alias("n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
with lines as (
  select doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents) s),
shared as (select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.doc_id, l.pos, l.line, s.k is not null and l.doc_id <> s.keeper as gone from lines l left join shared s on l.k = s.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
