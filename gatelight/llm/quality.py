"""Quality rules under weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document. Expectation-maximisation over the votes estimates how often each rule
votes each way on good and on bad documents; the posterior probability of quality then decides, in place of demanding that every rule
passes. Documents enter EM as counts per vote pattern, at most 3 to the power of the number of rules whatever the input. Native:
DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20  # percent of the words
SYMBOLS = "[#*$%&|<>]"
THRESHOLD = 0.5
MAX_ITERATIONS = 300
TOLERANCE = 1e-4  # largest move of any probability at which EM has converged


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (columns kept) plus word and line counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and rule measures.

    A repeated word is one inside a 5-word window whose words occur at two or more places of the text. Window hashes are 64-bit
    within one document. Only documents that have a repeat at all are sorted; everything stays in the row, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_w", words_of(text))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    out = out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_lines", lines)
    spots = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    windows = F.when(F.size("_h") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(spots, lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(WINDOW)])))
    out = out.withColumn("_g", windows)
    ordered = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    out = out.withColumn("_s", ordered)
    at = F.sequence(F.lit(0), F.size("_s") - 1)
    same = lambda a, b: F.col("_s")[a]["g"] == F.col("_s")[b]["g"]
    again = F.filter(at, lambda j: ((j > 0) & F.coalesce(same(F.greatest(j - 1, F.lit(0)), j), F.lit(False))) | ((j < F.size("_s") - 1) & F.coalesce(same(j, F.least(j + 1, F.size("_s") - 1)), F.lit(False))))
    out = out.withColumn("_at", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(again, lambda j: F.col("_s")[j]["i"]))))
    reach = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    count = lambda pattern: (F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    out = out.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", count("[\\x20\\x09-\\x0D]+"))
    out = out.withColumn("n_symbols", count("[^#*$%&|<>]+")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", F.coalesce(reach, F.lit(0)).cast("long")).withColumn("_n_lines", F.size("_lines"))
    out = out.withColumn("_capitals", count("[^\\p{Lu}]+")).withColumn("_letters", count("[^\\p{L}]+")).withColumn("_stops", count("[^.?]+")).withColumn("_shouts", count("[^!]+")).withColumn("_bars", count("[^|]+"))
    return out.drop("_t", "_w", "_h", "_lines", "_g", "_s", "_at")


def votes() -> dict[str, Column]:
    """Votes (1, 0, -1) per rule over the columns of ``measured``.

    Detectors of junk vote bad when they fire and abstain otherwise, since the absence of one fault says little; two rules that
    describe prose vote good. The bounds are far from what clean prose reaches.
    """
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def vote(good: Column | None, bad: Column) -> Column:
        return F.when(bad, -1).otherwise(0) if good is None else F.when(good, 1).when(bad, -1).otherwise(0)

    mean, stops = share("word_chars", "n_words"), share("_stops", "n_words")
    return {
        "length": vote(None, F.col("n_words") < MIN_WORDS),
        "symbols": vote(None, share("n_symbols", "n_words") > 0.1),
        "bars": vote(None, share("_bars", "n_words") > 0.1),
        "capitals": vote(None, share("_capitals", "_letters") > 0.3),
        "shouting": vote(None, share("_shouts", "n_words") > 0.2),
        "repeats": vote(None, share("n_repeat_words", "n_words") > 0.2),
        "dup_lines": vote(None, share("n_dup_lines", "_n_lines") > 0.3),
        "letters": vote(None, share("_letters", "word_chars") < 0.7),
        "sentences": vote(stops.between(0.02, 0.4), (stops < 0.005) & (F.col("n_words") >= 50)),
        "word_length": vote(mean.between(2.5, 12.0), (mean < 2.0) | (mean > 15.0)),
    }


def fit(patterns: DataFrame, rules: int, iterations: int = MAX_ITERATIONS) -> dict:
    """EM on pattern counts (``votes`` array and ``n``): prior of good, and P(vote | good), P(vote | bad) at [3 * rule + vote + 1].

    Starts from bad votes that fall on bad documents far more often than on good ones, and a prior of .8 for good; each
    step is one aggregate over at most 3**rules rows. The polarity of the start fixes which class is good. Counts are smoothed by one
    vote, so no rule ever gets a probability of 0. Stops when neither the prior nor any vote's probability moves by more than
    ``TOLERANCE``; ``converged`` in the result says whether it did, and a fit that has not gives a warning.
    """
    model = {"prior": 0.8, "good": [0.02, 0.68, 0.3] * rules, "bad": [0.3, 0.55, 0.15] * rules}
    for _ in range(iterations):
        weighed = patterns.withColumn("p", posterior(model, rules)).select("n", "p", F.posexplode("votes").alias("rule", "vote"))
        sums = weighed.groupBy("rule", "vote").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")).collect()
        n = sum(r["n"] for r in sums if r["rule"] == 0)
        good = math.fsum(r["good"] for r in sums if r["rule"] == 0)
        prior = (good + 1) / (n + 2)
        last, model = model, {"prior": prior, "good": [1 / (good + 3)] * (3 * rules), "bad": [1 / (n - good + 3)] * (3 * rules)}
        for r in sums:
            at = 3 * r["rule"] + r["vote"] + 1
            model["good"][at] = (r["good"] + 1) / (good + 3)
            model["bad"][at] = (r["n"] - r["good"] + 1) / (n - good + 3)
        moves = [abs(prior - last["prior"]), *(abs(a - b) for c in ("good", "bad") for a, b in zip(model[c], last[c]))]
        if max(moves) <= TOLERANCE:
            return model | {"converged": True}
    warnings.warn(f"EM has not converged in {iterations} steps", stacklevel=2)
    return model | {"converged": False}


def posterior(model: dict, rules: int) -> Column:
    """P(good | votes). The log odds are one array literal, so that every iteration runs the same compiled code."""
    gains = F.lit([math.log(g / b) for g, b in zip(model["good"], model["bad"])])
    score = F.element_at(F.lit([math.log(model["prior"] / (1 - model["prior"]))]), 1)
    for r in range(rules):
        score = score + F.element_at(gains, F.col("votes")[r] + (3 * r + 2))
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality (posterior) and kept.

    base_failed: under 10 words, or more than 20 percent of the words repeated. Kept: not base_failed and quality >= ``threshold``.
    The added columns win over like-named ones of ``docs``.

    Defined cases: null, empty and blank texts have no words and fail. Null ids and other null columns pass through. Repeated rows are
    all returned and get equal results. An empty table gives an empty table. Very long texts are measured whole, in their row.
    """
    scratch = Scratch(docs.sparkSession)
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    own = [c for c in docs.columns if c not in added]
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(text_col).alias("_text"))
    rules = votes()
    facts = measured(flat, "_text").drop("_text").withColumn("votes", F.array(*rules.values()))
    facts = scratch.keep(facts, "facts")
    patterns = scratch.keep(facts.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")
    model = fit(patterns, len(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    out = facts.withColumn("base_failed", failed).withColumn("quality", posterior(model, len(rules))).withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *added)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).drop("text")
