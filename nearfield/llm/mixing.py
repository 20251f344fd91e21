"""Mixing sources to target weights by entropy balancing.

Among all rates r >= 0 (copies of a document, at most `most`), the mix has the
one nearest to "every word once" in relative entropy, measured in words, whose
word totals meet the targets: minimise sum size * (r ln r - r + 1) subject to
sum size * r = target for each value of each margin. The solution is an
exponential tilt, r = min(most, exp(sum of the multipliers of the document's
values)). The multipliers maximise the dual, which is concave. Newton's steps
run over the cluster, a margin at a time: given the other margins' multipliers
the Hessian of one margin's is diagonal, so each value's slope and curvature
are sums over its cells (a cell is a combination of margin values). A second
aggregate tries the step and parts of it and takes, for each value, the one
that leaves the smallest gap; it always tries the step of proportional fitting
too, which never goes too far. One margin takes one step and one to see that
it is met; several take sweeps until all are met.

Rates are then rounded to whole copies: floor(r + u + shift)
with a hash u of the document. A cell's documents are taken by size, a class
for each power of two, from the largest down; each class has the shift that
brings its words closest to what the rates ask for and the larger classes left
over, found from a histogram of `BINS` bins. So the error ends up as small as
the smallest documents.

Sums, targets, multipliers, rates and shifts are tables; the driver sees one
row a step (the largest gap and movement), however many values there are.

Nulls and others: a null or empty text has size 0 and takes 0 words; a null
source is a source of its own, after all others; a repeated row is one more
document (its copies are decided alike when the ids are equal); an empty table
gives an empty result; other columns pass through `mix_copies` unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

BINS = 512
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """position: 0, 1, ... in order.

    Rows are written in ranges, numbered within each and moved up by the counts
    of the ranges before, so no task gets all rows.
    """
    dealt = scratch.table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as ranges
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(before, "_part").withColumn("position", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def source_targets(sums: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """value, target of sums (value, words): words that each source shall give.

    `weights` repeat over the sources by code point, null last. A target stops
    at `most` times its source's size; the excess is shared anew by weight
    among the others until none is above.
    """
    scratch = Scratch(sums.sparkSession, "targets")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    order = numbered(sums, scratch, F.col("value").asc_nulls_last())
    known = scratch.table(order.select("value", weight.alias("weight"), (F.col("words") * float(most)).alias("most"), "words"), "weights")
    whole = share * float(known.agg(F.sum("words")).first()[0] or 0)
    full, part, seen = F.lit(False), F.lit(None).cast("double"), -1
    while True:
        row = known.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if row[2] <= seen or not row[1]:  # none more is full, or all are
            break
        part, seen = F.col("weight") * (whole - (row[0] or 0.0)) / row[1], row[2]
        full = part > F.col("most")
    return known.select("value", F.when(full, F.col("most")).otherwise(part).alias("target"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], names: list[str], how: str = "inner") -> DataFrame:
    """An equi-join that also joins nulls; the planner broadcasts the right side if it is small enough."""
    on = None
    for a, b in zip(keys, names, strict=True):
        on = left[a].eqNullSafe(right[b]) if on is None else on & left[a].eqNullSafe(right[b])
    return left.join(right, on, how).drop(*[right[b] for b in names])


def _tilted(cells: DataFrame, names: list[str], duals: list[DataFrame]) -> DataFrame:
    """Cells with goal and multiplier of each margin, and their sum, the tilt; a value without a target has none."""
    out, tilt = cells, F.lit(0.0)
    for i, (name, dual) in enumerate(zip(names, duals, strict=True)):
        out = _same(out, dual.select(F.col("value").alias(f"v{i}"), F.col("goal").alias(f"goal{i}"), F.col("x").alias(f"x{i}")), [name], [f"v{i}"], "left")
        tilt = tilt + F.coalesce(F.col(f"x{i}"), F.lit(0.0))
    return out.withColumn("tilt", tilt)


def _newton_step(cells: DataFrame, names: list[str], duals: list[DataFrame], at: int, most: float, close: float) -> DataFrame:
    """value, goal, x of one margin after a step; gap before it, and how far x moved."""
    rows = _tilted(cells, names, duals)
    words = lambda d: F.col("n") * F.least(F.lit(most), F.exp(F.col("tilt") + d))
    sums = rows.groupBy(F.col(names[at]).alias("value")).agg(
        F.sum(words(F.lit(0.0))).alias("now"),
        F.sum(F.when(F.col("tilt") < math.log(most), words(F.lit(0.0))).otherwise(0.0)).alias("bend"),
        F.max(f"goal{at}").alias("goal"),
        F.max(f"x{at}").alias("x"),
    )
    gap = F.coalesce(F.abs(F.col("now") - F.col("goal")), F.lit(0.0))
    fitting = F.when(F.col("goal") <= 0, -40.0).when((F.col("bend") <= 0) & (F.col("now") < F.col("goal")), 0.0).otherwise(F.coalesce(F.log(F.try_divide("goal", "now")), F.lit(0.0)))
    fitting = F.when((gap <= close) | (F.col("now") <= 0), 0.0).otherwise(fitting)
    # the slope of log(now) is bend / now
    newton = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.coalesce(F.col("_fit") * F.try_divide("now", "bend"), F.col("_fit"))))
    steps = sums.withColumn("_fit", fitting).withColumn("_newton", newton).select("value", "goal", "x", gap.alias("gap"), "_fit", "_newton")
    tries = [F.col("_fit"), *(F.col("_newton") / 2**k for k in range(5))]
    tried = _same(rows, steps.select(F.col("value").alias("_value"), "_fit", "_newton"), [names[at]], ["_value"])
    left = [F.abs(F.sum(words(d)) - F.max(f"goal{at}")).alias(f"_left{k}") for k, d in enumerate(tries)]
    tried = tried.groupBy(F.col(names[at]).alias("_value")).agg(*left)
    both = _same(steps, tried, ["value"], ["_value"])
    best = F.array_min(F.array(*[F.struct(F.col(f"_left{k}").alias("left"), d.alias("d")) for k, d in enumerate(tries)]))["d"]
    return both.select("value", "goal", (F.col("x") + best).alias("x"), "gap", F.abs(best).alias("moved"))


def balanced_rates(cells: DataFrame, names: list[str], targets: list[DataFrame], most: float, *, sweeps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """names, words, rate, target of cells (names, n); targets are (value, target) for each of `names`.

    Newton on the dual, in sweeps over the margins, until no gap is above
    `tolerance` of all words or nothing moves any more. `target` is that of
    the first margin.
    """
    scratch = Scratch(cells.sparkSession, "balance")
    close = tolerance * max(1.0, float(cells.agg(F.sum("n")).first()[0] or 0))
    duals = [scratch.table(t.select(F.col("value").cast("string").alias("value"), F.col("target").cast("double").alias("goal"), F.lit(0.0).alias("x")), f"dual{i}") for i, t in enumerate(targets)]
    for _ in range(sweeps):
        gap = moved = 0.0
        for i in range(len(names)):
            duals[i] = scratch.table(_newton_step(cells, names, duals, i, most, close), f"dual{i}")
            row = duals[i].agg(F.max("gap"), F.max("moved")).first()
            gap, moved = max(gap, row[0] or 0.0), max(moved, row[1] or 0.0)
        if gap <= close or moved <= 1e-12:
            break
    rate = F.least(F.lit(most), F.exp(F.col("tilt")))
    rate = F.when(rate > most * (1 - 1e-7), F.lit(most)).otherwise(rate)  # on the cap to rounding: exactly the cap
    return scratch.table(_tilted(cells, names, duals).select(*names, F.col("n").alias("words"), rate.alias("rate"), F.col("goal0").alias("target")), "rates")


def mix_copies(docs: DataFrame, targets: list | None = None, *, margins: tuple[str, ...] = ("source",), text: str = "text", key: str = "doc_id", most: int = 2, targets_of=None, seed: int = 17) -> DataFrame:
    """The rows of docs with columns `size`, `cell_words`, `rate`, `target` and `copies` (0 to `most`).

    targets: for each margin a table (value, target) of words, or a dict; or
    targets_of, a function from the margins' word totals (tables of value and
    words) to those tables. `target` is that of the first margin. A margin's
    targets above `most` times its words, or margins that contradict each
    other, are met as nearly as the cap allows; a value without a target keeps
    a multiplier of 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size, u, rate, copies, target, words, shift, order = fresh(docs, "size", "_u", "rate", "copies", "target", "cell_words", "_shift", "_class")
    cell = fresh(docs, *[f"_cell{i}" for i in range(len(margins))])
    names = [f"c{i}" for i in range(len(margins))]
    # a draw of 32 bits; equal ids are told apart by nothing, so repeated rows are decided alike
    draw = (F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(4294967296.0)
    sized = docs.withColumn(size, word_count(F.col(text))).withColumn(u, draw)
    light = scratch.table(sized.select(*[F.col(m).cast("string").alias(c) for m, c in zip(margins, cell, strict=True)], F.col(size).alias("n"), F.col(u).alias("u")), "sizes")
    cells = scratch.table(light.groupBy(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)]).agg(F.sum("n").alias("n")), "cells")
    if targets_of:
        targets = targets_of([cells.groupBy(F.col(n).alias("value")).agg(F.sum("n").alias("words")) for n in names])
    tables = [t if isinstance(t, DataFrame) else spark.createDataFrame([(v, float(n)) for v, n in t.items()], "value string, target double") for t in targets]
    rates = balanced_rates(cells, names, tables, float(most))
    decided = rates.select(*names, F.col("words").alias(words), F.col("rate").alias(rate), F.col("target").alias(target))
    shifts = scratch.table(_shifts(light, cell, rates.select(*names, "rate"), names, most), "shifts").withColumnRenamed("shift", shift)
    keyed = sized.withColumns({c: F.col(m).cast("string") for m, c in zip(margins, cell, strict=True)} | {order: _class(F.col(size))})
    out = _same(keyed, decided, cell, names, "left")
    out = _same(out, shifts, [*cell, order], [*names, "cls"], "left")
    whole = F.floor(F.col(rate) + F.col(u) + F.coalesce(F.col(shift), F.lit(0.0)))
    return out.withColumn(copies, F.greatest(F.lit(0), F.least(F.lit(most), whole)).cast("int")).drop(*cell, order, u, shift)


def _class(size: Column) -> Column:
    """The power of two below a size; null for 0."""
    return F.floor(F.log2(F.when(size > 0, size).cast("double"))).cast("int")


def _shifts(light: DataFrame, cell: list[str], rates: DataFrame, names: list[str], most: int) -> DataFrame:
    """names, cls, shift: for each cell and size class the shift of its rounding.

    Copies step up by one where the shift passes j - rate - u, for j from 1 to
    `most`; a step is worth the document's words.
    """
    joined = _same(light.filter("n > 0"), rates, cell, names)
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: j - F.col("rate") - F.col("u")))
    at = F.floor((F.col("at") + 1.0) * (BINS / 2.0))
    bins = joined.select(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)], "rate", _class(F.col("n")).alias("cls"), "n", steps.alias("at"))
    bins = bins.groupBy(*names, "rate", "cls", F.greatest(F.lit(-1), F.least(F.lit(BINS), at)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        """One cell: at most a few dozen classes of BINS bins."""
        found, left = [], 0.0
        for cls in sorted(frame["cls"].unique(), reverse=True):
            part = frame[frame["cls"] == cls]
            mass = np.zeros(BINS + 1)  # bins from -1 to BINS - 1
            inside = part["bin"] < BINS
            mass[part["bin"][inside] + 1] = part["n"][inside]
            goal = float(part["rate"].iloc[0]) * float(part["n"].sum()) / most + left
            got = np.cumsum(mass)
            best = int(np.abs(got - goal).argmin())
            left = goal - float(got[best])
            found.append((*(frame[n].iloc[0] for n in names), int(cls), -1.0 + best * (2.0 / BINS)))
        return pd.DataFrame(found, columns=[*names, "cls", "shift"])

    return bins.groupBy(*names).applyInPandas(solve, ", ".join([*(f"{n} string" for n in names), "cls int, shift double"]))
