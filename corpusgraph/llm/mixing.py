"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates ``0 < w <= cap`` whose words meet each source's target, the
one nearest to 1 in relative entropy is an exponential tilt ``w = min(cap,
exp(lambda * size / scale))`` with one multiplier per source. The convex dual is
solved by distributed, safeguarded Newton steps on the table of (source, size, count),
and the rates are rounded to whole copies: a digest of the row decides each fraction, and
the threshold of each source is set, through two levels of histograms of the digests, where
its words meet the target. Sums are exact decimals, so reruns agree whatever the order of
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import private, small, unit, written

#: Source weights repeat in this pattern over the sources in code-point order.
WEIGHTS = (5, 2, 1)
#: Most copies of a document and the largest ratio of a target to its source's words.
CAP = 3
#: Newton steps at most; a step that leaves the bracket of the root is a bisection.
STEPS = 40
#: Cells of each level of the rounding histograms (the first over [0, 2)).
CELLS = 4096


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and TAB..CR (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exact(x: Column) -> Column:
    """``x`` for a sum that doesn't depend on the order of rows."""
    return x.cast("decimal(38,9)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh as ``weights`` repeats and share all
    words; a target stops at ``cap`` times its source and the excess is shared again by
    weight until none is above. The shared level is found by sorting sources by how
    early they saturate; the table has one row per source, never per document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(x)) for x in weights])
    weighed = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ratio = F.col("source_size") * cap / F.col("weight")
    done = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = done.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # a source is below its stop if the level, with all earlier ones stopped, is below its ratio
    first = weighed.withColumn("level", level).withColumn("free", F.col("level") <= ratio)
    return first.withColumn("shared", F.min(F.when(F.col("free"), F.struct(ratio, F.col("level")))).over(everything)["level"]).select(
        "source", "source_size", F.when(F.col("shared").isNull(), F.col("source_size") * float(cap)).otherwise(F.least(F.col("weight") * F.col("shared"), F.col("source_size") * float(cap))).alias("target")
    )


def multipliers(histogram: DataFrame, goals: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """``(source, scale, lam)`` solving each source's dual on ``histogram(source, size,
    n)``. A target at the cap has the multiplier +infinity, one of 0 words -infinity. A source
    that hasn't converged after ``steps`` keeps its last multiplier; the rounding meets its
    target all the same."""
    spread = histogram.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).cast("double").alias("scale"), F.min("size").alias("least"))
    state = goals.where("source_size > 0").alias("g").join(spread.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "g.source_size", "target", "scale", "least")
    full, none = F.col("target") >= F.col("source_size") * float(cap), F.col("target") <= 0
    limit = F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")  # there every document is at the cap
    state = written(
        state.select(
            "source", "target", "scale", F.lit(0.0).alias("lam"), (-745.0 * F.col("scale") / F.col("least")).alias("lo"), limit.alias("hi"),
            F.when(full, float("inf")).when(none, float("-inf")).alias("fixed"),
        ),
        "dual",
    )
    rows = histogram.where("size > 0").select(F.col("source").alias("h_source"), "size", "n")
    for _ in range(steps):
        open_ = state.where("fixed is null")
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        mass = F.col("size") * F.col("n") * rate
        found = (
            rows.join(small(open_, open_.count(), 100_000), F.col("source").eqNullSafe(F.col("h_source")))
            .groupBy("source")
            .agg(F.sum(exact(mass)).cast("double").alias("words"), F.sum(exact(F.when(F.col("lam") * x < F.log(F.lit(float(cap))), mass * x).otherwise(0.0))).cast("double").alias("slope"))
        )
        over = F.col("words") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("words") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        near = F.abs(F.col("words") - F.col("target")) <= 1e-9 * F.col("target") + 1e-6
        moved = state.alias("s").join(found.alias("f").withColumnRenamed("source", "f_source"), F.col("s.source").eqNullSafe(F.col("f_source")), "left")
        state = written(
            moved.select("s.source", "target", "scale", F.when(near | F.col("words").isNull(), F.col("lam")).otherwise(step).alias("lam"), F.when(near | F.col("words").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(near | F.col("words").isNull(), F.col("hi")).otherwise(hi).alias("hi"), F.when(near, F.col("lam")).otherwise(F.col("fixed")).alias("fixed")),
            "dual",
        )
        if state.where("fixed is null").isEmpty():
            break
    return state.select("source", "scale", F.coalesce("fixed", "lam").alias("lam"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, unit, size, source_size, target, rate, copies, taken``.

    Only the three named columns are read. A null or wordless text has size 0, rate and
    copies of 1 and takes nothing. A null source is one source. Repeated rows count
    each and, where id, source and text agree, are taken alike. If all sources are empty, targets are 0. An empty table gives no rows. The
    result depends on the rows alone, so reruns agree."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    base = written(base.select("doc_id", "source", unit("doc_id", "source", "text").alias("unit"), n_words(F.col("text")).alias("size")), "sizes")
    histogram = written(base.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    goals = written(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "targets")
    duals = multipliers(histogram, goals, cap).withColumnRenamed("source", "d_source")
    table = written(goals.join(duals, F.col("source").eqNullSafe(F.col("d_source")), "left").select(F.col("source").alias("t_source"), "source_size", F.col("target").cast("double").alias("target"), "scale", "lam"), "tilts")
    n_sources = table.count()
    rate = F.when(F.col("lam").isNull() | (F.col("size") == 0), 1.0).when(F.col("lam") == float("inf"), float(cap)).when(F.col("lam") == float("-inf"), 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    rated = base.join(small(table, n_sources, 100_000), F.col("source").eqNullSafe(F.col("t_source"))).withColumn("rate", rate)
    part = F.col("rate") - F.floor("rate")
    draw = (F.pmod(F.xxhash64("unit", F.lit("copies")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rated = rated.withColumn("part", part).withColumn("v", F.when(part > 0, draw / part))
    # v is compared with its source's threshold; up to it, a fraction counts as a copy
    level = F.least(F.floor(F.col("v") * (CELLS // 2)), F.lit(CELLS - 1))
    fine = F.least(F.floor((F.col("v") * (CELLS // 2) - level) * CELLS), F.lit((1 << 40) - 1))
    rated = rated.withColumn("cell", level).withColumn("fine", fine)

    def edge(sums: DataFrame, at: str) -> DataFrame:
        """Per source (with what it still ``need``s) the step at which the running words reach
        the need, and the need that is left before it."""
        running = Window.partitionBy("t_source").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        stepped = sums.withColumn("below", F.sum("extra").over(running) - F.col("extra")).where("below < need and below + extra >= need")
        return stepped.groupBy("t_source").agg(F.min(at).alias(f"{at}_edge"), F.min_by(F.col("need") - F.col("below"), at).alias("need"))

    whole = rated.groupBy("t_source", "cell").agg(F.sum("size").alias("extra"), F.sum(F.col("size") * F.floor("rate")).alias("sure"), F.first("target").alias("target"))
    whole = written(whole, "cells")
    needs = written(whole.groupBy("t_source").agg((F.first("target") - F.sum("sure")).alias("need")), "needs")
    same = lambda x: F.col("t_source").eqNullSafe(F.col(x))
    renamed = lambda x: x.withColumnRenamed("t_source", "o_source")
    first = written(edge(whole.where("cell is not null").select("t_source", "cell", "extra").join(renamed(needs), same("o_source")).drop("o_source"), "cell"), "edges")
    inner = rated.join(small(renamed(first), n_sources, 100_000), same("o_source")).where("cell = cell_edge")
    second = written(edge(inner.groupBy("t_source", "fine").agg(F.sum("size").alias("extra"), F.first("need").alias("need")), "fine"), "edges")
    # what is left of a need lies in one cell of the second level: a few documents
    last = inner.drop("need", "o_source").join(small(renamed(second), n_sources, 100_000), same("o_source")).where("fine = fine_edge")
    groups = last.groupBy("t_source", "v", "unit").agg(F.sum("size").alias("extra"), F.first("need").alias("need"))
    in_cell = Window.partitionBy("t_source").orderBy("v", "unit").rowsBetween(Window.unboundedPreceding, 0)
    inside = groups.withColumn("inside", F.sum("extra").over(in_cell) - F.col("extra") / 2 <= F.col("need"))
    threshold = inside.groupBy("t_source").agg(F.max(F.when(F.col("inside"), F.struct("v", "unit"))).alias("limit"))

    bound = needs.select("t_source", "need").join(renamed(first.drop("need")), same("o_source"), "left").drop("o_source")
    bound = bound.join(renamed(second.drop("need")), same("o_source"), "left").drop("o_source")
    bound = written(bound.join(renamed(threshold), same("o_source"), "left").select(F.col("t_source").alias("b_source"), "need", "cell_edge", "fine_edge", "limit"), "thresholds")
    ready = rated.join(small(bound, n_sources, 100_000), same("b_source"))
    # without an edge the target lies beyond all fractions (take them) or below the sure copies (take none)
    place, stop = F.struct("cell", "fine"), F.struct(F.col("cell_edge").alias("cell"), F.col("fine_edge").alias("fine"))
    taken = F.when(F.col("cell_edge").isNull(), F.col("need") > 0).when(place == stop, F.coalesce(F.struct("v", "unit") <= F.col("limit"), F.lit(False))).otherwise(place < stop)
    copies = (F.floor("rate") + F.when((F.col("part") > 0) & taken, 1).otherwise(0)).cast("int")
    return ready.withColumn("copies", copies).select("doc_id", "unit", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row repeated as often as the mixture takes it, all columns
    unchanged. Rows that agree in id, source and text are taken alike."""
    own, key, copies, turn = private(docs, "unit", "key", "copies", "turn")
    plan = mixture(docs, weights, cap).where("copies > 0").groupBy("unit").agg(F.max("copies").alias(copies)).withColumnRenamed("unit", key)
    joined = docs.withColumn(own, unit("doc_id", "source", "text")).join(plan, F.col(own) == F.col(key))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{x}`") for x in docs.columns))
