"""Command line: python -m linkwright.plans.cli train|predict|decide|train-neural|predict-neural|check ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators import decide
from ..session import ship
from ..sources import files
from . import linkage


def _sources(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(files.read_records(spark, f"{folder}/{kind}_source{i}.tsv") for i in (1, 2, 3))


def parser() -> argparse.ArgumentParser:
    # The commands, their flags and their defaults.
    top = argparse.ArgumentParser(prog="linkwright")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("train")
    p.add_argument("--train-dir", default="dataset/train")
    p.add_argument("--model-out", default="model")
    p.add_argument("--sample-s1", type=int)
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("predict")
    p.add_argument("--test-dir", default="dataset/test")
    p.add_argument("--model", default="model")
    p.add_argument("--out-dir", default="output")
    p = sub.add_parser("decide")
    p.add_argument("--scored", required=True)
    p.add_argument("--mode", choices=("val", "test"), required=True)
    p.add_argument("--test-dir")
    p.add_argument("--out-dir", default="output")
    p.add_argument("--lambda-grid", default=",".join(map(str, decide.LAMBDAS)))
    p.add_argument("--lambda-val", type=float)
    p.add_argument("--rule", choices=decide.RULES)
    p.add_argument("--threshold", type=float, default=0.5)
    p = sub.add_parser("train-neural")
    p.add_argument("--train-dir", default="dataset/train")
    p.add_argument("--val-frac", type=float, default=0.3)
    p.add_argument("--dl-epochs", type=int, default=10)
    p.add_argument("--rl-epochs", type=int, default=20)
    p.add_argument("--model-dir", default="model_neural")
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("predict-neural")
    p.add_argument("--test-dir", default="dataset/test")
    p.add_argument("--model-dir", default="model_neural")
    p.add_argument("--out-dir", default="output_neural")
    p.add_argument("--use-rl", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--fixed-threshold", type=float, default=0.5)
    p = sub.add_parser("check")
    p.add_argument("--test-dir", default="dataset/test")
    p.add_argument("--matching", default="output/matching_results")
    p.add_argument("--candidate", default="output/candidate_pairs")
    p.add_argument("--strict", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkwright").getOrCreate()
    ship(spark)
    if a.command == "train":
        truth = files.read_truth(spark, f"{a.train_dir}/train_ground_truth.tsv")
        print(linkage.train(spark, *_sources(spark, a.train_dir, "train"), truth, a.model_out, a.sample_s1, a.seed))
    elif a.command == "predict":
        linkage.predict(spark, *_sources(spark, a.test_dir, "test"), a.model, a.out_dir)
    elif a.command == "decide":
        scored = files.read_scores(spark, a.scored)
        if a.mode == "val":
            truth = scored.where("label = 1")
            ids = scored.select("source1_entity_id").distinct()
            print(linkage.tune(scored, truth, ids, a.threshold, [float(x) for x in a.lambda_grid.split(",") if x.strip()]))
        else:
            if not a.test_dir or not a.rule:
                parser().error("--mode test needs --test-dir and --rule")
            ids = files.read_records(spark, f"{a.test_dir}/test_source1.tsv")
            kept = decide.apply_rule(scored, a.rule, a.threshold, a.lambda_val)
            files.write_id_lists(files.id_lists(kept, ids.select("entity_id"), "matched_entity_ids"), f"{a.out_dir}/matching_results")
    elif a.command == "train-neural":
        truth = files.read_truth(spark, f"{a.train_dir}/train_ground_truth.tsv")
        print(linkage.train_neural(spark, *_sources(spark, a.train_dir, "train"), truth, a.model_dir, a.val_frac, a.dl_epochs, a.rl_epochs, a.seed))
    elif a.command == "predict-neural":
        linkage.predict_neural(spark, *_sources(spark, a.test_dir, "test"), a.model_dir, a.out_dir, a.use_rl, a.fixed_threshold)
    else:
        n, shown = linkage.check(spark, *_sources(spark, a.test_dir, "test"), a.matching, a.candidate, a.strict)
        print("\n".join([f"{n} issues", *shown]) if n else "no issues")
        return int(n > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
