"""F-beta, macro reports and sweeps, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA = 0.5


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = BETA) -> Column:
    """F-beta of one entity from counts (A-1): 1 if nothing is true or predicted, 0 if only one is."""
    b2 = beta * beta
    value = F.lit(1 + b2) * tp / (n_pred + F.lit(b2) * n_true)
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).when((n_pred == 0) | (n_true == 0), F.lit(0.0)).otherwise(value)


def threshold_grid(first: float = 0.05, last: float = 0.95, step: float = 0.02) -> list[float]:
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


#: 46 thresholds for boosted trees, 17 for the neural matcher.
TREE_GRID = threshold_grid()
NEURAL_GRID = threshold_grid(0.10, 0.90, 0.05)


def population(ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The entities to average over: all ids, or only those with candidates (the first column is the id)."""
    every = ids.select(F.col(ids.columns[0]).alias("source1_entity_id")).distinct()
    return every if candidates is None else every.join(candidates, "source1_entity_id", "left_semi")


def entity_counts(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """source1_entity_id, tp, n_pred, n_true of every id (A-3, J-8), from distinct pairs."""
    key = ["source1_entity_id", "other_id"]
    pred = predicted.select(*key).distinct().withColumn("p", F.lit(1))
    true = truth.select(*key).distinct().withColumn("t", F.lit(1))
    both = pred.join(true, key, "full_outer").groupBy("source1_entity_id")
    counts = both.agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    return population(ids).join(counts, "source1_entity_id", "left").fillna(0, subset=["tp", "n_pred", "n_true"])


def entity_scores(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    counts = entity_counts(predicted, truth, ids)
    return counts.withColumn("f05", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def _report() -> list[Column]:
    alone = F.col("n_true") == 0
    return [
        F.avg("f05").alias("macro_f05"),
        F.count(F.lit(1)).alias("n_s1"),
        F.avg(F.when(alone, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"),
        F.count_if(alone).alias("n_singletons"),
    ]


def macro_report(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """macro_f05, n_s1, singleton_accuracy (null without singletons), n_singletons (A-2, A-4)."""
    return entity_scores(predicted, truth, ids).agg(*_report())


def report_by_country(predicted: DataFrame, truth: DataFrame, countries: DataFrame) -> DataFrame:
    """The report per country and, under a null country, over all. countries: source1_entity_id, country."""
    rows = entity_scores(predicted, truth, countries).join(countries.dropDuplicates(["source1_entity_id"]), "source1_entity_id")
    return rows.rollup("country").agg(*_report(), F.grouping("country").alias("is_total"))


def threshold_sweep(scored: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[float] = TREE_GRID) -> DataFrame:
    """threshold, macro_f05 for every threshold (D-7, D-8).

    One pass: an entity's counts for all thresholds are columns of one
    aggregation, so neither rows nor jobs multiply by the grid.
    """
    key = ["source1_entity_id", "other_id"]
    true = truth.select(*key).distinct().withColumn("_true", F.lit(1))
    rows = scored.groupBy(*key).agg(F.max("score").alias("score")).join(true, key, "left")
    hit = lambda t, more: F.count_if((F.col("score") >= t) & more)
    columns = [c for i, t in enumerate(grid) for c in (hit(t, F.lit(True)).alias(f"n{i}"), hit(t, F.col("_true").isNotNull()).alias(f"t{i}"))]
    counts = rows.groupBy("source1_entity_id").agg(*columns)
    total = true.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n_true"))
    every = population(ids).join(counts, "source1_entity_id", "left").join(total, "source1_entity_id", "left").fillna(0)
    means = every.agg(*(F.avg(f_beta(F.col(f"t{i}"), F.col(f"n{i}"), F.col("n_true"))).alias(f"f{i}") for i in range(len(grid))))
    cells = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("macro_f05")) for i, t in enumerate(grid)))
    return means.select(F.inline(cells))


def best(sweep: DataFrame, by: str) -> DataFrame:
    """The row of the highest macro_f05, the smallest `by` on ties; rounded, so that noise does not decide."""
    return sweep.orderBy(F.desc(F.round("macro_f05", 12)), by).limit(1)
