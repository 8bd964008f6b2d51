"""Train, predict, decide and check, as Spark jobs between written tables.

The three cut points are the same in every run: candidates, features, scores.
Each is a Parquet table in the run's folder, so that a later step reads what
an earlier one made and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, decide, features, labels, metrics, model, neural, policy, validate
from ..sources import files


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def featured(source1: DataFrame, source2: DataFrame, source3: DataFrame, folder: str, **options) -> DataFrame:
    """Candidates with features and both records' fields, written under folder."""
    candidates = _kept(blocking.generate_candidates(source1, source2, source3, **options), f"{folder}/candidates")
    left, right = features.record_lookup(source1), features.record_lookup(source2.unionByName(source3, allowMissingColumns=True))
    return _kept(features.compute_features(candidates, left, right, fields=True), f"{folder}/features")


def train(spark: SparkSession, source1: DataFrame, source2: DataFrame, source3: DataFrame, truth: DataFrame, folder: str, sample: int | None = None, seed: int = 42, rounds: int = 300, everyone: bool = True, **options) -> dict:
    """Fit the tree model, choose a threshold on held-out ids, and write model, held-out scores and a sidecar.

    everyone: average over all held-out ids; else over those with candidates.
    """
    positives = files.truth_pairs(truth)
    if sample:
        ids = labels.sample_ids(source1.select("entity_id"), sample, seed)
        source1 = labels.keep_ids(source1, ids, "entity_id")
        positives = labels.keep_ids(positives, ids)
    rows = labels.split(labels.label(featured(source1, source2, source3, folder, **options), positives), 0.2, seed)
    fitted = model.fit(rows.where(~F.col("held_out")), rounds=rounds, seed=seed)
    model.save(fitted, f"{folder}/model")
    scored = _kept(model.score(fitted, rows.where("held_out")).select(*files.LABELLED.names), f"{folder}/val_scored")
    held = labels.split(source1.select(F.col("entity_id").alias("source1_entity_id")), 0.2, seed).where("held_out").select("source1_entity_id")
    ids = metrics.population(held, None if everyone else scored)
    sweep = metrics.threshold_sweep(scored, positives.join(ids, "source1_entity_id", "left_semi"), ids)
    top = metrics.best(sweep, "threshold").first()
    ceiling = labels.recall_ceiling(spark.read.parquet(f"{folder}/candidates"), positives).first()
    # The keys of the sidecar.
    told = {"threshold": top["threshold"], "val_macro_f0.5": top["macro_f05"], "blocking_recall_ceiling": ceiling["recall"], "n_candidate_pairs": rows.count()}
    files.write_sidecar(spark, told, f"{folder}/metadata")
    return told


def predict(spark: SparkSession, source1: DataFrame, source2: DataFrame, source3: DataFrame, model_folder: str, folder: str, **options) -> DataFrame:
    """Score all candidates with a trained model and write candidates and matches as id lists; the scored pairs."""
    rows = featured(source1, source2, source3, folder, **options)
    scored = _kept(model.score(model.load(f"{model_folder}/model"), rows).select(*files.SCORED.names), f"{folder}/scored_candidates")
    at = files.read_sidecar(spark, f"{model_folder}/metadata")["threshold"]
    finish(scored, decide.threshold(scored, at), source1, folder)
    return scored


def finish(candidates: DataFrame, matches: DataFrame, source1: DataFrame, folder: str, one_file: bool = False) -> None:
    """Write candidate_pairs and matching_results under folder."""
    ids = source1.select("entity_id")
    files.write_id_lists(files.id_lists(candidates, ids, "candidate_entity_ids"), f"{folder}/candidate_pairs", one_file)
    files.write_id_lists(files.id_lists(matches, ids, "matched_entity_ids"), f"{folder}/matching_results", one_file)


def tune(scored: DataFrame, truth: DataFrame, ids: DataFrame, at: float = 0.5, grid: list[float] | None = None) -> dict:
    """The best lambda of the grid with and without one-to-one, the four rules' reports, and the best rule."""
    grid = list(grid or decide.LAMBDAS)
    plain = metrics.best(decide.lambda_grid(scored, truth, ids, grid), "lambda").first()["lambda"]
    single = metrics.best(decide.lambda_grid(scored, truth, ids, grid, exclusive=True), "lambda").first()["lambda"]
    rows = [r.asDict() for r in decide.compare_rules(scored, truth, ids, at, plain, single).collect()]
    return {"lambda": plain, "lambda_one_to_one": single, "rules": rows, "best": max(rows, key=lambda r: (round(r["macro_f05"], 12), -decide.RULES.index(r["rule"])))["rule"]}


def train_neural(spark: SparkSession, source1: DataFrame, source2: DataFrame, source3: DataFrame, truth: DataFrame, folder: str, held_out: float = 0.3, epochs: int = 10, policy_epochs: int = 20, seed: int = 42, **options) -> dict:
    """Fit the neural matcher and the stopping policy; write both and a report of fixed threshold against policy."""
    positives = files.truth_pairs(truth)
    rows = labels.split(labels.label(featured(source1, source2, source3, folder, **options), positives), held_out, seed)
    matcher, _ = neural.fit(rows.where(~F.col("held_out")), epochs=epochs, seed=seed)
    scored = _kept(neural.score(matcher, rows).select(*files.LABELLED.names, "held_out"), f"{folder}/neural_scored")
    rewards: list[float] = []
    fitted = policy.train(policy.episodes(scored.where(~F.col("held_out")), positives, seed=seed), epochs=policy_epochs, seed=seed, log=rewards)
    every = labels.split(source1.select(F.col("entity_id").alias("source1_entity_id")), held_out, seed)
    ids = every.where("held_out").select("source1_entity_id")
    true, val = positives.join(ids, "source1_entity_id", "left_semi"), scored.where("held_out")
    fixed = metrics.best(metrics.threshold_sweep(val, true, ids, metrics.NEURAL_GRID), "threshold").first()
    learned = metrics.macro_report(decide.policy_greedy(val, fitted), true, ids).first()
    spark.createDataFrame([(bytearray(matcher.dumps()), policy.dumps(fitted))], "matcher binary, policy string").write.mode("overwrite").parquet(f"{folder}/neural_model")
    told = {
        "n_train_s1": every.where(~F.col("held_out")).count(), "n_val_s1": ids.count(), "n_candidate_pairs": rows.count(),
        "baseline_fixed_threshold": fixed["threshold"], "baseline_fixed_threshold_f05": fixed["macro_f05"], "rl_policy_f05": learned["macro_f05"],
    }
    files.write_sidecar(spark, told, f"{folder}/report")
    files.write_sidecar(spark, {"expected_f05": rewards}, f"{folder}/policy_rewards")
    return told


def predict_neural(spark: SparkSession, source1: DataFrame, source2: DataFrame, source3: DataFrame, model_folder: str, folder: str, use_policy: bool = True, at: float = 0.5, **options) -> DataFrame:
    """Matches of the neural matcher, by its policy or by a fixed threshold, written as id lists (D-10)."""
    saved = spark.read.parquet(f"{model_folder}/neural_model").first()
    rows = featured(source1, source2, source3, folder, **options)
    scored = _kept(neural.score(neural.Matcher.loads(bytes(saved["matcher"])), rows).select(*files.SCORED.names), f"{folder}/neural_candidates")
    matches = decide.policy_greedy(scored, policy.loads(saved["policy"])) if use_policy else decide.threshold(scored, at)
    finish(scored, matches, source1, folder)
    return matches


def check(spark: SparkSession, source1: DataFrame, source2: DataFrame, source3: DataFrame, matches: str, candidates: str, strict: bool = False) -> tuple[int, list[str]]:
    """Number of format violations of written results, and the first of them."""
    known = source2.select("entity_id").union(source3.select("entity_id")).distinct()
    found = validate.issues(files.read_id_lists(spark, matches, "matched_entity_ids"), files.read_id_lists(spark, candidates, "candidate_entity_ids"), source1.select("entity_id"), known, strict)
    return validate.report(found)
