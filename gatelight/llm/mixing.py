"""Mixing sources to target weights by entropy balancing.

Each document gets a rate exp(lambda of its source): among all rates that meet the token constraints, those closest in relative
entropy to taking everything once. Newton iterations on the convex dual find the multipliers from the per-source token counts, which one
aggregate over all documents makes. With source totals as the only constraints the dual falls apart into one equation a source, and the
iterations end at target / size, as a closed form would; they are carried out all the same, until each has converged. Targets by source and by language (or any
columns) at once do not fall apart: ``coupled_rates`` takes Newton steps with the whole Hessian, which one aggregate over the cells of the columns gives a step.
Rates are then rounded into copies: every document gets the whole part, and documents in a fixed random order get one copy more until
the source's target is met. Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, word_count, words_of

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
MAX_COPIES = 3
BUCKET_BITS = 10  # the rounding order is dealt out by its first bits, so that a hot source is never in one task
NEWTON_STEPS = 80  # at most; a source that has not converged by then is an error
CONVERGED = 1e-12  # of the target


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Per source (src, source_size) its target: shares of the whole by weight, held at ``cap`` times the source's size.

    The excess of capped sources goes to the others by weight until none is above. With sources in order of size per weight this is
    a single pass: the first k are capped, where k is the smallest count that leaves the next one under its cap. One row per source.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("src").isNull(), "src")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.select("src", "source_size", weight.alias("w"))
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = ranked.withColumn("cut", F.struct(left.alias("left"), F.sum("w").over(onward).alias("ws")))
    opens = F.col("cut.left") * F.col("w") / F.col("cut.ws") <= cap * F.col("source_size")
    level = level.withColumn("cut", F.first(F.when(opens, F.col("cut")), ignorenulls=True).over(whole))
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("cut.left") * F.col("w") / F.col("cut.ws"))
    return level.select("src", "source_size", target.alias("target"))


def newton_rates(targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """``targets`` plus ``rate`` = exp(lambda), by Newton steps on the dual sum(size * exp(lambda)) - sum(target * lambda).

    There is one token constraint per source and no document is in two, so the Hessian is diagonal: each multiplier steps by its own
    gradient over its own curvature, all sources in parallel, and a step is clipped to 1 so that a far start cannot
    overshoot. A source stops when its tokens are within ``CONVERGED`` of its target; one that does not within ``steps`` raises an error in
    place of a wrong rate. A source without tokens or target keeps rate 1.
    """

    def step(lam):
        tokens = F.col("source_size") * F.exp(lam)
        move = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (tokens - F.col("target")) / tokens))
        return F.when(F.abs(tokens - F.col("target")) <= CONVERGED * F.col("target"), lam).otherwise(lam - move)

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda lam, _: step(lam))
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    solved = targets.withColumn("rate", F.when(solvable, F.exp(lam)).otherwise(F.lit(1.0)))
    off = solvable & (F.abs(F.col("rate") * F.col("source_size") - F.col("target")) > CONVERGED * F.col("target"))
    return solved.withColumn("rate", F.when(off, F.raise_error(F.lit(f"the rate of a source has not converged in {steps} steps")).cast("double")).otherwise(F.col("rate")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """``docs`` plus size, source_size, target, copies, extra_words and taken; these win over like-named columns.

    ``copies`` are whole; the last document of each source whose turn comes takes ``extra_words`` words besides, so that the
    source meets its target to the word: taken = copies * size + extra_words, never over ``cap`` * size. The rounding order is the
    MD5 of the id, so reruns agree.

    Defined cases: null source is a source of its own, last in order. A null, empty or blank text has size 0 and takes nothing.
    Repeated rows are equal in order: the words they take are the same whichever comes first. Null ids come first in the
    rounding order. An empty table gives an empty table.
    """
    return _mixed(docs, id_col, text_col, F.col(source_col), lambda sizes: newton_rates(source_targets(sizes, weights, cap)), cap)


def mix_by(docs: DataFrame, targets: dict[str, dict], id_col: str = "doc_id", text_col: str = "text", cap: int = 1000) -> DataFrame:
    """``mix`` under targets by several columns at once: ``targets`` has, per column of ``docs``, the words of each of its values (those of a null under None).

    Targets are met per cell of the columns to the word, so those of each value to a word per cell. Added columns and cases are those of ``mix``, where "source" is the cell.
    A value without a target is not taken. Rates over ``cap`` are an error, as are targets that no rates can meet.
    """
    dims = list(targets)
    cell = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(dims)])

    def rates(sizes: DataFrame) -> DataFrame:
        cells = sizes.select("src", "source_size", *[F.col("src")[f"v{i}"].alias(c) for i, c in enumerate(dims)])
        solved = coupled_rates(cells, targets, "source_size").select("src", "source_size", (F.col("rate") * F.col("source_size")).alias("target"), "rate")
        over = F.raise_error(F.lit(f"a rate is over {cap}")).cast("double")
        return solved.withColumn("rate", F.when(F.col("rate") > cap, over).otherwise(F.col("rate")))

    return _mixed(docs, id_col, text_col, cell, rates, cap)


def coupled_rates(cells: DataFrame, targets: dict[str, dict], size: str = "size", steps: int = NEWTON_STEPS) -> DataFrame:
    """``cells`` plus ``rate`` = exp(sum of one multiplier per column of ``targets``): nearest, in relative entropy, to taking everything once.

    ``cells``: one row per combination of the columns, with ``size``; ``targets``: per column the tokens wanted of each value. The dual is convex and its Hessian couples
    columns through the cells: each step sums gradient and Hessian over the cells in one aggregate (a row per pair of values that meet), solves the system of all values on the driver
    (values, not documents: thousands at most), and halves the step while the dual does not fall. Values without a target, or with target 0, get rate 0, and so do cells without
    tokens. Raises ValueError if the columns' targets do not sum to the same or cannot be met.
    """
    dims, scratch = list(targets), Scratch(cells.sparkSession)
    wanted = {c: {v: float(t) for v, t in targets[c].items() if t > 0} for c in dims}
    sums = [sum(w.values()) for w in wanted.values()]
    if max(sums) - min(sums) > 1e-9 * max(sums):
        raise ValueError(f"targets must sum to the same over each column: {dict(zip(dims, sums))}")
    place = {(c, v): k for k, (c, v) in enumerate((c, v) for c in dims for v in wanted[c])}
    goal = np.array([wanted[c][v] for c, v in place])

    def of(c: str, values: dict):
        out = F.lit(None).cast("double")
        for v, x in values.items():
            out = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(float(x))).otherwise(out)
        return out

    cells_kept = scratch.keep(cells, "cells")
    open_ = F.col(size) > 0
    for c in dims:
        open_ = open_ & of(c, dict.fromkeys(wanted[c], 0.0)).isNotNull()
    # the multipliers sum to the cell's exponent
    exponent = lambda lam: sum((of(c, {v: lam[place[c, v]] for v in wanted[c]}) for c in dims[1:]), of(dims[0], {v: lam[place[dims[0], v]] for v in wanted[dims[0]]}))

    def measured(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = cells_kept.filter(open_).withColumn("_w", F.col(size) * F.exp(exponent(lam)))
        met = taken.groupBy(*dims).agg(F.sum("_w").alias("_w")).collect()  # cells of the targets' values
        hessian = np.zeros((len(goal), len(goal)))
        for r in met:
            at = [place[c, r[c]] for c in dims]
            hessian[np.ix_(at, at)] += r["_w"]
        return np.diag(hessian).copy(), hessian

    lam = np.zeros(len(goal))
    got, hessian = measured(lam)
    dual = lambda lam, got: got.sum() / len(dims) - goal @ lam
    for _ in range(steps):
        if (np.abs(got - goal) <= 1e-9 * goal).all():
            rate = F.when(open_, F.exp(exponent(lam))).otherwise(0.0)
            return cells_kept.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        move = np.linalg.lstsq(hessian, got - goal, rcond=1e-12)[0]  # columns share one degree of freedom: the least move of those that do
        size_of = 1.0 / max(1.0, np.abs(move).max() / 2)
        before = dual(lam, got)
        while size_of > 1e-6:
            tried = lam - size_of * move
            new, curved = measured(tried)
            if dual(tried, new) <= before + 1e-12 * abs(before):
                break
            size_of /= 2
        lam, got, hessian = tried, new, curved
    raise ValueError(f"targets cannot be met: off by {np.abs(got - goal).max():.3g} tokens after {steps} steps")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source, rates_of, cap: int) -> DataFrame:
    """``mix`` under the rates that ``rates_of`` gives to sizes (src, source_size)."""
    scratch, added = Scratch(docs.sparkSession), ("size", "source_size", "target", "copies", "extra_words", "taken")
    own = [c for c in docs.columns if c not in added]
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], source.alias("src"), F.col(id_col).alias("d"), word_count(F.col(text_col)).alias("size"))
    rows = flat.withColumn("o", F.md5(F.coalesce(F.col("d").cast("string"), F.lit(""))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("o", 1, 3), 16, 10).cast("int"), 12 - BUCKET_BITS))
    sizes = scratch.keep(rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")), "sizes")
    rates = rates_of(sizes.groupBy("src").agg(F.sum("n").alias("source_size")))
    rates = rates.withColumn("whole", F.least(F.floor(F.col("rate") + 1e-9), F.lit(cap)).cast("long")).withColumnRenamed("src", "s")
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = F.round(F.round(F.col("rate") * F.col("source_size"), 5)).cast("long") - F.col("whole") * F.col("source_size")
    plan = sizes.join(rates, F.col("src").eqNullSafe(F.col("s")))
    plan = plan.select(F.col("s").alias("ps"), F.col("bucket").alias("pb"), "source_size", "target", "whole", (goal - upto).alias("extra"))
    met = rows.join(plan, F.col("src").eqNullSafe(F.col("ps")) & (F.col("bucket") == F.col("pb")))
    turn = Window.partitionBy("ps", "pb").orderBy("o", "d", "size").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.coalesce(F.sum("size").over(turn), F.lit(0)))))
    full = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    copies = F.col("whole") + full.cast("long")
    extra = F.when(full, F.lit(0)).otherwise(F.col("more")).cast("long")
    return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "size", "source_size", "target", copies.alias("copies"), extra.alias("extra_words"), (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy, and for the cut copy of a source one row with the words it takes.

    Defined cases: those of ``mix``. All columns of ``docs`` pass through as they are, whatever their names; only the text of a cut copy changes.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    taken = mix(flat, of[id_col], of[text_col], of[source_col], weights, cap)
    times = (F.col("copies") + (F.col("extra_words") > 0).cast("long")).cast("int")
    rows = taken.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    text = of[text_col]
    part = F.array_join(F.slice(words_of(F.col(text)), 1, F.col("extra_words").cast("int")), " ")
    body = F.when(F.col("copy") <= F.col("copies"), F.col(text)).otherwise(part)
    return rows.select(*[(body if n == text else F.col(n)).alias(c) for c, n in of.items()])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as o from documents),
sources as (select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from sized group by source),
levels as (select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over (
      order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as room,
    sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as ws,
    row_number() over (order by source_size / w, source nulls last) as k from sources),
cut as (select arg_min(room, k) as room, arg_min(ws, k) as ws from levels where room * w / ws <= 3 * source_size),
targets as (select source, source_size, least((3 * source_size)::double, cut.room * w / cut.ws) as target from levels, cut),
rounded as (select *, floor(target / source_size + 1e-9)::bigint as whole, round(target)::bigint as goal from targets where source_size > 0
  union all select *, 1, 0 from targets where source_size = 0),
turns as (select s.*, r.source_size, r.target, r.whole, r.goal - r.whole * r.source_size as extra,
    coalesce(sum(s.size) over (partition by s.source order by o, doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as seen
  from sized s join rounded r on s.source is not distinct from r.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - seen)))::bigint as taken from turns
"""
