"""Decision rules over scored candidates (source1_entity_id, other_id, score).

Ties always go to the smaller other_id (for one-to-one: the smaller source-1 id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

LAMBDAS = [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0]
RULES = ("threshold", "one_to_one_threshold", "expected_f05", "one_to_one_expected_f05")
#: Candidates that the stopping policy looks at, at most.
MAX_STEPS = 15
EPSILON = 1e-6


def threshold(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """score >= at (D-1)."""
    return scored.where(F.col("score") >= at)


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each other_id only with the source-1 record it scores highest with (W-3)."""
    line = Window.partitionBy("other_id").orderBy(F.desc("score"), "source1_entity_id")
    return scored.withColumn("_rank", F.row_number().over(line)).where("_rank = 1").drop("_rank")


def one_to_one_threshold(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """D-1, then one-to-one (D-2)."""
    return one_to_one(threshold(scored, at))


def _expected(scored: DataFrame, lam: Column, by: list[str]) -> DataFrame:
    """Adds rank and best_m, the prefix length that the estimate favours; all windows share one exchange."""
    line = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    upto, whole = line.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    p = F.least(F.greatest(F.col("score"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    rows = scored.withColumn("_p", p).withColumn("rank", F.row_number().over(line))
    rows = rows.withColumns({"_run": F.sum("_p").over(upto), "_total": F.sum("_p").over(whole), "_none": F.sum(F.log(1 - F.col("_p"))).over(whole)})
    value = F.round(F.lit(1.25) * F.col("_run") / (F.col("rank") + F.lit(0.25) * (F.col("_total") + lam)), 12)
    rows = rows.withColumns({"_value": value, "_zero": F.round(F.exp(F.col("_none") - lam), 12)})
    rows = rows.withColumn("_top", F.max("_value").over(whole))
    first = F.min(F.when(F.col("_value") == F.col("_top"), F.col("rank"))).over(whole)
    return rows.withColumn("best_m", F.when(F.col("_top") > F.col("_zero"), first).otherwise(F.lit(0))).drop("_p", "_run", "_total", "_none", "_value", "_zero", "_top")


def expected_f05(scored: DataFrame, lam: float = 0.3) -> DataFrame:
    """The prefix of each entity's candidates with the highest expected F0.5 (D-3); the shortest on ties."""
    return _expected(scored, F.lit(float(lam)), ["source1_entity_id"]).where("rank <= best_m").drop("rank", "best_m")


def one_to_one_expected_f05(scored: DataFrame, lam: float = 0.3) -> DataFrame:
    """One-to-one first, then D-3 on what is left (D-4)."""
    return expected_f05(one_to_one(scored), lam)


def relative_threshold(scored: DataFrame, ratio: float = 0.9) -> DataFrame:
    """score >= ratio * the entity's best score (X-17)."""
    top = F.max("score").over(Window.partitionBy("source1_entity_id"))
    return scored.withColumn("_top", top).where(F.col("score") >= F.lit(ratio) * F.col("_top")).drop("_top")


def lambda_grid(scored: DataFrame, truth: DataFrame, ids: DataFrame, lambdas: list[float] = LAMBDAS, exclusive: bool = False) -> DataFrame:
    """lambda, macro_f05 of D-3 for each lambda (D-5); with `exclusive`, after one-to-one. One job."""
    rows = one_to_one(scored) if exclusive else scored
    rows = rows.select("source1_entity_id", "other_id", "score", F.explode(F.array(*map(F.lit, lambdas))).alias("lambda"))
    kept = _expected(rows, F.col("lambda"), ["source1_entity_id", "lambda"]).where("rank <= best_m")
    true = truth.select("source1_entity_id", "other_id").distinct().withColumn("_true", F.lit(1))
    counts = kept.join(true, ["source1_entity_id", "other_id"], "left").groupBy("source1_entity_id", "lambda").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_true").alias("tp"))
    total = true.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n_true"))
    every = metrics.population(ids).join(total, "source1_entity_id", "left").withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas))))
    every = every.join(counts, ["source1_entity_id", "lambda"], "left").fillna(0, subset=["n_pred", "tp", "n_true"])
    return every.groupBy("lambda").agg(F.avg(metrics.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("macro_f05"))


def apply_rule(scored: DataFrame, rule: str, at: float = 0.5, lam: float | None = None) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}: one of {', '.join(RULES)}")
    if "expected" in rule and lam is None:
        raise ValueError(f"{rule} needs a lambda")
    if rule == "threshold":
        return threshold(scored, at)
    if rule == "one_to_one_threshold":
        return one_to_one_threshold(scored, at)
    return expected_f05(scored, lam) if rule == "expected_f05" else one_to_one_expected_f05(scored, lam)


def compare_rules(scored: DataFrame, truth: DataFrame, ids: DataFrame, at: float = 0.5, lam: float = 0.3, lam_exclusive: float = 0.3) -> DataFrame:
    """rule and its report, for all four rules (D-6)."""
    out = None
    for rule in RULES:
        kept = apply_rule(scored, rule, at, lam_exclusive if rule.startswith("one") else lam)
        row = metrics.macro_report(kept, truth, ids).select(F.lit(rule).alias("rule"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def bucket_thresholds(scored: DataFrame, table: DataFrame, default: float = 0.5, widths: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Thresholds by number of candidates and source (X-13). table: bucket, source, threshold."""
    n = F.count(F.lit(1)).over(Window.partitionBy("source1_entity_id"))
    rows = scored.withColumn("bucket", F.lit(len(widths)))
    for i in reversed(range(len(widths))):
        rows = rows.withColumn("bucket", F.when(n <= widths[i], F.lit(i)).otherwise(F.col("bucket")))
    rows = rows.join(table, ["bucket", "source"], "left")
    return rows.where(F.col("score") >= F.coalesce("threshold", F.lit(default))).drop("threshold")


# ---- learned stopping policy


STATE = ("p", "step", "mean_before", "mass_left", "below_top", "gap", "n")


def policy_states(scored: DataFrame) -> DataFrame:
    """Candidates with rank (from 1) and the state that the policy sees at each (W-5).

    Sums and the count run over all of an entity's candidates, also those
    beyond MAX_STEPS.
    """
    line = Window.partitionBy("source1_entity_id").orderBy(F.desc("score"), "other_id")
    whole = Window.partitionBy("source1_entity_id")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = scored.withColumns({
        "rank": F.row_number().over(line),
        "_run": F.sum("score").over(upto),
        "_total": F.sum("score").over(whole),
        "_count": F.count(F.lit(1)).over(whole),
        "_top": F.max("score").over(whole),
        "_next": F.coalesce(F.lead("score").over(line), F.lit(0.0)),
    })
    t = F.col("rank") - 1
    before = F.col("_run") - F.col("score")
    return rows.withColumns({
        "p": F.col("score"),
        "step": t / F.lit(float(MAX_STEPS)),
        "mean_before": F.round(before / F.greatest(t, F.lit(1)), 12),
        "mass_left": F.round(F.col("_total") - before, 12),
        "below_top": F.col("_top") - F.col("score"),
        "gap": F.col("score") - F.col("_next"),
        "n": F.col("_count") / F.lit(float(MAX_STEPS)),
    }).drop("_run", "_total", "_count", "_top", "_next")


def policy_logit(weights: dict) -> Column:
    """The policy's network as an expression. weights: w1 (7 x hidden), b1, w2 (hidden), b2."""
    out = F.lit(float(weights["b2"]))
    for k, w in enumerate(weights["w2"]):
        z = F.lit(float(weights["b1"][k]))
        for i, name in enumerate(STATE):
            z = z + F.lit(float(weights["w1"][i][k])) * F.col(name)
        out = out + F.lit(float(w)) * F.greatest(z, F.lit(0.0))
    return F.round(out, 9)


def policy_greedy(scored: DataFrame, weights: dict) -> DataFrame:
    """Candidates up to the first that the policy would not go on with, MAX_STEPS at most (D-9, W-8, W-9)."""
    rows = policy_states(scored).withColumn("_on", (policy_logit(weights) >= 0) & (F.col("rank") <= MAX_STEPS))
    upto = Window.partitionBy("source1_entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_all", F.bool_and("_on").over(upto)).where("_all").drop(*STATE, "rank", "_on", "_all")
