"""The driver's contract: registered queries against their SQL, plans, and what remains without the removable part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from linkwright.operators import blocking, extra
from linkwright.plans import cli, linkage, oracle, queries
from linkwright.sources import files, fixtures
from linkwright.streaming import matching

ROOT = Path(__file__).resolve().parent.parent
SOME = ["n_clean", "n_soundex", "n_postcode", "b_keys", "b_capped_pairs", "b_candidates", "f_addr_token_sort", "f_formula_score", "d_one_to_one_expected_f05", "d_policy_greedy", "m_threshold_sweep", "m_by_country", "s_id_list", "v_not_in_candidates", "x_tfidf_knn", "x_agreement", "x_embedding_knn", "x_embedding_passes", "x_name_key_pairs", "x_pair_details", "x_french_region", "x_transliterated"]


def plain(df):
    cell = lambda x: None if x is None or x != x else round(float(x), 9) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("part", "documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf, con, name):
    ours, theirs = e.queries()[name](spark, sf).toPandas(), con.sql(e.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and plain(ours) == plain(theirs)


def test_registration():
    have = e.queries()
    assert set(e.oracle_sql()) <= set(have)
    without = set(queries.QUERIES) - set(oracle.ORACLE)
    assert without == {"f_partial", "f_addr_partial", "f_all", "g_calibrated", "g_gbt_scores", "g_neural_scores", "g_out_of_fold", "g_policy_matches"}


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_the_rest_stands_alone():
    """The library imports without its removable subpackage."""
    code = "import sys; sys.modules['linkwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'b_candidates' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for f in (ROOT / "linkwright").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text()


def test_plans(spark, sf):
    one, both = queries.prepared(spark, sf)
    plan = blocking.best_candidates(blocking.scored_pairs(blocking.bucket_pairs(one, both)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    scan = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").where("p_size > 10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)]" in scan


def test_partitions_do_not_matter(spark, sf):
    s1, s2, s3 = fixtures.sources(spark, sf)
    a = sorted(blocking.generate_candidates(s1, s2, s3).collect())
    b = sorted(blocking.generate_candidates(s1.repartition(7), s2.repartition(1), s3.repartition(3)).collect())
    assert a == b


@pytest.fixture(scope="module")
def dataset(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for kind in ("train", "test"):
        for i, df in enumerate(fixtures.sources(spark, sf), 1):
            df.toPandas().to_csv(folder / f"{kind}_source{i}.tsv", sep="\t", index=False)
    fixtures.relation(spark, sf, "fx_ground_truth").toPandas().to_csv(folder / "train_ground_truth.tsv", sep="\t", index=False)
    return str(folder)


def test_train_predict_decide_check(spark, dataset, tmp_path, monkeypatch):
    fit = linkage.model.fit
    monkeypatch.setattr(linkage.model, "fit", lambda rows, **o: fit(rows, **(o | {"rounds": 3})))
    model, out = str(tmp_path / "m"), str(tmp_path / "o")
    assert cli.main(["train", "--train-dir", dataset, "--model-out", model], spark) == 0
    told = files.read_sidecar(spark, f"{model}/metadata")
    assert told["n_candidate_pairs"] == 339 and told["blocking_recall_ceiling"] == pytest.approx(269 / 283) and told["val_macro_f0.5"] > 0.5
    assert cli.main(["predict", "--test-dir", dataset, "--model", model, "--out-dir", out], spark) == 0
    check = ["check", "--test-dir", dataset, "--matching", f"{out}/matching_results", "--candidate", f"{out}/candidate_pairs", "--strict"]
    assert cli.main(check, spark) == 0
    assert cli.main(["decide", "--scored", f"{model}/val_scored", "--mode", "val"], spark) == 0
    assert cli.main(["decide", "--scored", f"{out}/scored_candidates", "--mode", "test", "--test-dir", dataset, "--out-dir", out, "--rule", "one_to_one_expected_f05", "--lambda-val", "0.4"], spark) == 0
    assert cli.main(check, spark) == 0


def test_neural_path(spark, dataset, tmp_path):
    model, out = str(tmp_path / "m"), str(tmp_path / "o")
    assert cli.main(["train-neural", "--train-dir", dataset, "--model-dir", model, "--dl-epochs", "2", "--rl-epochs", "2"], spark) == 0
    assert set(files.read_sidecar(spark, f"{model}/report")) == {"n_train_s1", "n_val_s1", "n_candidate_pairs", "baseline_fixed_threshold", "baseline_fixed_threshold_f05", "rl_policy_f05"}
    for flag in ("--use-rl", "--no-use-rl"):
        assert cli.main(["predict-neural", "--test-dir", dataset, "--model-dir", model, "--out-dir", out, flag], spark) == 0
        assert cli.main(["check", "--test-dir", dataset, "--matching", f"{out}/matching_results", "--candidate", f"{out}/candidate_pairs"], spark) == 0


def test_stream(spark, sf, tmp_path):
    s1, s2, s3 = fixtures.sources(spark, sf)
    for i in range(2):
        s1.where(f"crc32(encode(entity_id, 'UTF-8')) % 2 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    reference = matching.prepare_reference(s2, s3, str(tmp_path / "ref"))
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    matching.start(stream, reference, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blocking.generate_candidates(s1, s2, s3).select(found.columns).collect()))


def test_kept_only_if_better():
    assert extra.better(0.902, 0.9) and not extra.better(0.9015, 0.9)
