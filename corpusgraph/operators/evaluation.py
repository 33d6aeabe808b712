"""Retrieval metrics per case and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def retrieval_metrics(runs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``(case_id, metric, value)`` of ``runs(case_id, rank, chunk_id)`` against
    ``gold(case_id, chunk_id)``: hit, precision (repeats count, divided by k), recall
    (distinct), binary nDCG at each k, and MRR. A case without gold has no metrics; one
    without results has zeros."""
    marked = runs.join(gold.distinct().withColumn("good", F.lit(1)), ["case_id", "chunk_id"], "left")
    at = [(k, F.col("rank") <= k) for k in ks]
    parts = [F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first")]
    for k, near in at:
        good = near & (F.col("good") == 1)
        parts += [F.count_if(good).alias(f"n{k}"), F.count_distinct(F.when(good, F.col("chunk_id"))).alias(f"d{k}"), F.sum(F.when(good, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}")]
    sums = marked.groupBy("case_id").agg(*parts)
    rows = gold.distinct().groupBy("case_id").agg(F.count("*").alias("gold")).join(sums, "case_id", "left")
    values = [("mrr", F.coalesce(1 / F.col("first"), F.lit(0.0)))]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        values += [
            (f"hit@{k}", F.when(zero(f"n{k}") > 0, 1.0).otherwise(0.0)),
            (f"precision@{k}", zero(f"n{k}") / k),
            (f"recall@{k}", zero(f"d{k}") / F.col("gold")),
            (f"ndcg@{k}", F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / ideal),
        ]
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.round(value.cast("double"), 6).alias("value")) for name, value in values])
    return rows.select("case_id", F.explode(pairs).alias("x")).select("case_id", "x.metric", "x.value")


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the non-blank keywords that the answer has in any case; 0 without any."""
    words = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda w: w.isNotNull() & (F.trim(w) != ""))
    hit = F.filter(words, lambda w: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.trim(w))))
    return F.when(F.size(words) > 0, F.size(hit) / F.size(words)).otherwise(0.0)


def evaluate(runs: DataFrame, cases: DataFrame, answers: DataFrame | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Case metrics of ``cases(id, expected_chunk_ids, expected_keywords, ...)``; the keyword
    metric only where a case has an answer and keywords."""
    gold = cases.select(F.col("id").alias("case_id"), F.explode("expected_chunk_ids").alias("chunk_id"))
    out = retrieval_metrics(runs, gold, ks)
    if answers is not None:
        said = cases.select(F.col("id").alias("case_id"), "expected_keywords").where("size(expected_keywords) > 0").join(answers.where("answer is not null"), "case_id")
        out = out.unionByName(said.select("case_id", F.lit("keyword_coverage").alias("metric"), F.round(keyword_coverage(F.col("answer"), F.col("expected_keywords")), 6).alias("value")))
    return out


def summary(metrics: DataFrame, cases: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Mean and number of cases of each metric; with ``by`` (a column of ``cases``) for each
    of its values and, as null, overall."""
    if by is None:
        return metrics.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    joined = metrics.join(cases.select(F.col("id").alias("case_id"), by), "case_id")
    return joined.groupBy("metric", by).agg(F.sum("value").alias("s"), F.count("*").alias("c")).rollup("metric", by).agg(F.round(F.sum("s") / F.sum("c"), 6).alias("mean"), F.sum("c").alias("n")).where("metric is not null")


def compare_runs(off: DataFrame, on: DataFrame) -> DataFrame:
    """Means of two runs side by side, and their difference."""
    left, right = (summary(x).select("metric", F.col("mean").alias(name)) for x, name in ((off, "off_value"), (on, "on_value")))
    return left.join(right, "metric", "full_outer").withColumn("difference", F.round(F.col("on_value") - F.col("off_value"), 6))


def compare_cases(off: DataFrame, on: DataFrame) -> DataFrame:
    """``(case_id, metric, off_value, on_value, difference)`` of each case of two runs; a case or
    metric that one run lacks is null there."""
    left, right = (x.select("case_id", "metric", F.col("value").alias(name)) for x, name in ((off, "off_value"), (on, "on_value")))
    return left.join(right, ["case_id", "metric"], "full_outer").withColumn("difference", F.round(F.col("on_value") - F.col("off_value"), 6))
