"""License scans by ordered signature rules.

Each rule (``license_rules``) is a regex with a keyword, a label and a level of certainty. A text is tried only against rules whose keyword it holds. Detections are
intervals of words. A detection goes if another one of the same or a surer level contains it (of two equal ones the earlier rule's stays), so
"general public license" inside "GNU General Public License, version 3" says nothing of its own, and overlapping detections that do not contain each
other all stay.

Native: DataFrame functions only. A document is scanned within its row, so nothing is shuffled, whatever the skew. In order of start, longest
first, whatever contains a detection stands before it; so one pass with the largest end so far by level settles all, in linear time and constant memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import CONFIDENCE, rules

#: The phrases of the base count and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE_LEVEL = 4  # a base phrase is as sure as a bare name
OPEN, CLOSE = "\x01", "\x02"  # never part of a word


def _whole(regex: str | Column) -> Column:
    """A regex that matches whole words of a text with blanks around each."""
    return F.concat(F.lit("(?<= )(?:"), F.lit(regex) if isinstance(regex, str) else regex, F.lit(")(?= )"))


def _places(body: Column, regex: Column) -> Column:
    """(start, end) in words, from 0, of the matches of a regex in a text with blanks around each word; the end is exclusive.

    Matches are marked in the text, and the marked words are then found by their number: linear in the text, however many there are.
    """
    words = F.split(F.btrim(F.regexp_replace(body, regex, F.lit(f"{OPEN}$0{CLOSE}"))), " ")
    at = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i.cast("long"))), lambda i: i.isNotNull())
    return F.zip_with(at(lambda w: F.startswith(w, F.lit(OPEN))), at(lambda w: F.endswith(w, F.lit(CLOSE))), lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def _signatures() -> Column:
    """Keywords with their rules: array of (keyword, array of (level, label, regex))."""
    by_keyword: dict[str, list] = {}
    for number, (level, label, keyword, regex) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append((number, level, label, regex))
    rule = lambda n, level, label, regex: F.struct(F.lit(n).alias("no"), F.lit(level).alias("level"), F.lit(label).alias("label"), _whole(regex).alias("regex"))
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[rule(*r) for r in own]).alias("rules")) for k, own in by_keyword.items()])


def _settled(detections: Column) -> Column:
    """(label, level, places, first_word, last_word) by label of the detections that no other contains. ``detections`` are in order of start, then longest first."""
    levels = max(CONFIDENCE)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), levels).alias("ends"), F.array().cast("array<struct<label:string,level:int,places:bigint,first_word:bigint,last_word:bigint>>").alias("found"))

    def step(state, d):
        inside = F.element_at(state["ends"], d["level"]) >= d["end"]
        ends = F.transform(state["ends"], lambda x, i: F.when(i + 1 >= d["level"], F.greatest(x, d["end"])).otherwise(x))
        known = F.exists(state["found"], lambda f: f["label"] == d["label"])
        one = F.struct(d["label"].alias("label"), d["level"].alias("level"), F.lit(1).cast("long").alias("places"), d["start"].alias("first_word"), d["start"].alias("last_word"))
        more = lambda f: F.struct(f["label"].alias("label"), F.least(f["level"], d["level"]).alias("level"), (f["places"] + 1).alias("places"), f["first_word"].alias("first_word"), d["start"].alias("last_word"))
        added = F.when(known, F.transform(state["found"], lambda f: F.when(f["label"] == d["label"], more(f)).otherwise(f))).otherwise(F.array_append(state["found"], one))
        return F.struct(ends.alias("ends"), F.when(inside, state["found"]).otherwise(added).alias("found"))

    return F.aggregate(detections, start, step, lambda state: state["found"])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and detections; these win over like-named columns.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, numbered from 0. ``n_base`` counts the places of the base phrases, first_word and last_word are their
    smallest and largest start (null without one), base_labels their labels. ``labels`` adds those of the detections that stay; both are sorted and joined by
    commas. ``detections`` lists per label its surest level, places, first and last start. ``score`` is the confidence of the surest of them or of a base phrase, 0 without any.

    Defined cases: a null, empty or blank text has no words and no label; label strings are then empty. Rows need no id and do not meet; repeated rows give
    equal results. Other columns pass through, whatever their names. An empty table gives an empty table.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    own = [c for c in docs.columns if c not in added]
    names = [f"c{i}" for i in range(len(own))]
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(own, names)], F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, BREAKS, " ")), F.lit(" ")).alias("body"))
    body = F.col("body")
    out = out.withColumn("n_words", F.when(F.length("body") > 2, F.length("body") - F.length(F.replace(body, F.lit(" "))) - 1).otherwise(0).cast("long"))
    any_phrase = F.lit(False)
    for phrase, _ in PHRASES:
        any_phrase = any_phrase | F.contains(body, F.lit(f" {phrase} "))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.withColumn("base", F.when(any_phrase, _places(body, _whole("|".join(p for p, _ in PHRASES)))).otherwise(none))
    base_labels = F.filter(F.array(*[F.when((F.size("base") > 0) & F.contains(body, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES]), lambda x: x.isNotNull())
    out = out.withColumn("base_set", F.array_sort(F.array_distinct(base_labels)))
    tried = F.flatten(F.transform(F.filter(_signatures(), lambda k: F.contains(body, k["keyword"])), lambda k: k["rules"]))
    out = out.withColumn("tried", tried)
    spans = lambda r: F.transform(_places(body, r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), r["level"].alias("level"), r["no"].alias("no"), r["label"].alias("label"), p["end"].alias("end")))
    out = out.withColumn("spans", F.array_sort(F.flatten(F.transform("tried", spans))))
    out = out.withColumn("detections", _settled(F.col("spans")))
    labels = F.array_sort(F.array_union("base_set", F.transform("detections", lambda d: d["label"])))
    sure = F.lit(0.0)
    best = F.least(F.array_min(F.transform("detections", lambda d: d["level"])), F.when(F.size("base") > 0, F.lit(BASE_LEVEL)))
    for level, confidence in CONFIDENCE.items():
        sure = F.when(best == level, F.lit(confidence)).otherwise(sure)
    return out.select(
        *[F.col(x).alias(c) for c, x in zip(own, names)], "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        F.array_join("base_set", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), sure.alias("score"), "detections",
    )


def op11_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    """The same in SQL: blanks are doubled, so that each match has blanks of its own on both sides."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    double = lambda s: s.replace(" ?", "(?:_)?").replace(" ", "  ").replace("_", "  ")  # noqa: E731  no rule has an underscore
    values = ",\n".join(f"({n}, {level}, {quote(label)}, {quote(keyword)}, {quote(' (?:' + double(regex) + ') ')})" for n, (level, label, keyword, regex) in enumerate(rules()))
    phrases = ",\n".join(f"({n - len(PHRASES)}, 0, {quote(label)}, {quote(f' {phrase} ')}, {quote(' (?:' + double(phrase) + ') ')})" for n, (phrase, label) in enumerate(PHRASES))
    sure = " ".join(f"when {level} then {confidence}::double" for level, confidence in CONFIDENCE.items())
    return f"""
with rules(no, level, label, keyword, regex) as (values {phrases},
{values}),
plain as (select row_number() over () as k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAKS}', ' ', 'g'), ' ') as t from documents),
docs as (select k, doc_id, ' ' || t || ' ' as body, '  ' || replace(t, ' ', '  ') || '  ' as wide, case when t = '' then 0 else len(string_split(t, ' ')) end as n_words from plain),
tried as (select k, no, level, label, regexp_extract_all(wide, regex) as hits, string_split_regex(wide, regex) as gaps from docs join rules on contains(body, keyword)),
pieces as (select k, no, level, label, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as i from tried where len(hits) > 0),
sized as (select *, len(regexp_extract_all(hit, '[^ ]+')) as length, len(regexp_extract_all(gap, '[^ ]+')) as before from pieces),
spans as (select k, no, level, label, start, start + length as ends from (select *, sum(before + length) over (partition by k, no order by i) - length as start from sized) s),
base as (select k, count(*) as n_base, min(start) as first_word, max(start) as last_word, list_sort(list(distinct label)) as labels from spans where no < 0 group by k),
found as (select * from spans d where no >= 0 and not exists (select 1 from spans e where e.no >= 0 and e.k = d.k and e.level <= d.level and e.start <= d.start and e.ends >= d.ends
  and (e.start, -e.ends, e.level, e.no) < (d.start, -d.ends, d.level, d.no))),
judged as (select k, list(distinct label) as labels, min(level) as level from found group by k)
select doc_id, n_words::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(b.labels, ','), '') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(j.labels, [])))), ',') as labels,
  case least(j.level, case when n_base > 0 then {BASE_LEVEL} end) {sure} else 0::double end as score
from docs left join base b using (k) left join judged j using (k)
"""


SQL = _sql()
