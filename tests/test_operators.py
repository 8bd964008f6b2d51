"""Operators against plain Python on small relations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.operators import blocking, decide, features, labels, metrics, model, neural, policy, validate
from linkwright.sources import files, fixtures

RECORD = "entity_id string, business_name string, business_address string, country string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def relations(spark, sf):
    return fixtures.sources(spark, sf)


@pytest.fixture(scope="module")
def candidates(spark, relations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c"))
    blocking.generate_candidates(*relations).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_fixture_statistics(relations, candidates, spark, sf):
    """Counts that an independent model of the pipeline gave for these relations."""
    assert [r.count() for r in relations] == [200, 133, 150]
    one, both = blocking.prepared(relations[0]), blocking.prepared(blocking.tagged(*relations[1:]))
    shared = blocking.shared_keys(one, both).groupBy("source", "key_type").count()
    assert {(r["source"], r["key_type"]): r["count"] for r in shared.collect()} == dict(zip([("S2", i) for i in range(5)] + [("S3", i) for i in range(5)], [117, 123, 123, 84, 139, 195, 125, 125, 137, 195], strict=True))
    pairs = blocking.bucket_pairs(one, both)
    assert dict(rows(pairs.groupBy("source").count(), "source", "count")) == {"S2": 169, "S3": 200}
    assert dict(rows(blocking.scored_pairs(pairs).groupBy("source").count(), "source", "count")) == {"S2": 162, "S3": 177}
    truth = files.truth_pairs(fixtures.relation(spark, sf, "fx_ground_truth"))
    assert rows(labels.recall_ceiling(candidates, truth), "recovered", "positives") == [(269, 283)]
    assert candidates.count() == 339 and candidates.select("source1_entity_id").distinct().count() == 184


def test_a_pair_comes_once_and_the_cap_binds(spark):
    one = spark.createDataFrame([("A", "acme corp", "1 Main St 12345", "US")], RECORD)
    two = spark.createDataFrame([(f"B{i}", "acme corp", f"{i} Main St 12345", "USA") for i in range(5)], RECORD)
    none = spark.createDataFrame([], RECORD)
    p1, p2 = blocking.prepared(one), blocking.prepared(blocking.tagged(two, none))
    assert blocking.bucket_pairs(p1, p2).count() == 5  # five pairs although they share several keys
    assert rows(blocking.bucket_pairs(p1, p2, 4), "other_id") == [("B1",)]  # only its own house and digits are rare
    assert rows(blocking.oversize_report(p1, p2, 4), "source", "buckets", "records") == [("S2", 3, 15)]
    assert blocking.generate_candidates(one, two, none, top_k=2).count() == 2
    assert blocking.generate_candidates(none, two, none).columns == ["source1_entity_id", "other_id", "source", "name_cosine_sim"]


def test_one_id_in_both_sources(spark):
    one = spark.createDataFrame([("A", "acme", "", "US")], RECORD)
    same = spark.createDataFrame([("X", "acme", "", "US")], RECORD)
    found = blocking.generate_candidates(one, same, same)
    assert rows(found, "other_id", "source") == [("X", "S2")]


def test_nameless_records_meet_at_an_address(spark):
    one = spark.createDataFrame([("A", None, "1 Main St 12345", "US")], RECORD)
    two = spark.createDataFrame([("B", "nan", "1 Main Street 12345", "USA")], RECORD)
    found = blocking.generate_candidates(one, two, two.limit(0)).collect()
    assert [(r["other_id"], r["name_cosine_sim"]) for r in found] == [("B", 1.0)]


def test_top_k_of_all_is_top_k_of_bucket_tops(spark, relations):
    one, both = blocking.prepared(relations[0]), blocking.prepared(blocking.tagged(*relations[1:]))
    scored = blocking.scored_pairs(blocking.bucket_pairs(one, both)).toPandas()
    keyed = blocking.shared_keys(one, both).toPandas().merge(scored, on=["source1_entity_id", "other_id", "source"])
    order = dict(by=["name_cosine_sim", "other_id"], ascending=[False, True])
    tops = keyed.sort_values(**order).groupby(["source1_entity_id", "source", "key_type"]).head(3)
    tops = tops.drop_duplicates(["source1_entity_id", "other_id"]).sort_values(**order).groupby(["source1_entity_id", "source"]).head(3)
    found = rows(blocking.best_candidates(spark.createDataFrame(scored), 3), "source1_entity_id", "other_id")
    assert found == sorted(map(tuple, tops[["source1_entity_id", "other_id"]].values))


def test_features(spark, relations, candidates):
    found = features.compute_features(candidates, features.record_lookup(relations[0]), features.record_lookup(relations[1].unionByName(relations[2])))
    assert found.columns[-10:] == list(features.FEATURES) and found.count() == 339
    got = found.agg(F.max(F.abs(F.col("name_cosine_sim") - F.col("name_token_sort_ratio"))).alias("d"), F.min("name_partial_ratio").alias("lo"), F.max("name_partial_ratio").alias("hi")).first()
    assert got["d"] < 1e-9 and 0 < got["lo"] <= got["hi"] <= 1
    lone = spark.createDataFrame([("Z", "Y")], "source1_entity_id string, other_id string")
    r = features.compute_features(lone, features.record_lookup(relations[0]), features.record_lookup(relations[1])).first()
    assert r["name_token_sort_ratio"] == 1.0 and r["country_match"] == 0.0  # missing records have empty fields


SCORED = "source1_entity_id string, other_id string, score double"


def expected_m(p, lam):
    p = sorted((min(max(x, 1e-6), 1 - 1e-6) for x in p), reverse=True)
    best, m = round(math.prod(1 - x for x in p) * math.exp(-lam), 12), 0
    for k in range(1, len(p) + 1):
        e = round(1.25 * sum(p[:k]) / (k + 0.25 * (sum(p) + lam)), 12)
        if e > best:
            best, m = e, k
    return m


def test_expected_f05(spark):
    rng = np.random.default_rng(5)
    groups = {"A": [0.9, 0.6, 0.2], "B": [0.1], "C": [0.0, 1.0], **{f"R{i}": rng.random(rng.integers(1, 20)).round(4).tolist() for i in range(40)}}
    df = spark.createDataFrame([(g, f"{k:02d}", float(p)) for g, ps in groups.items() for k, p in enumerate(ps)], SCORED)
    kept = dict(rows(decide.expected_f05(df, 0.3).groupBy("source1_entity_id").count(), "source1_entity_id", "count"))
    assert {g: kept.get(g, 0) for g in groups} == {g: expected_m(p, 0.3) for g, p in groups.items()}
    assert kept["A"] == 1 and "B" not in kept


def test_rules(spark):
    df = spark.createDataFrame([("A", "x", 0.9), ("B", "x", 0.8), ("B", "y", 0.7), ("C", "z", 0.5), ("D", "x", 0.9)], SCORED)
    pick = lambda d: rows(d, "source1_entity_id", "other_id")
    assert pick(decide.one_to_one(df)) == [("A", "x"), ("B", "y"), ("C", "z")]
    assert pick(decide.one_to_one_threshold(df, 0.7)) == [("A", "x"), ("B", "y")]
    assert pick(decide.threshold(df, 0.8)) == [("A", "x"), ("B", "x"), ("D", "x")]
    assert pick(decide.relative_threshold(df, 0.9)) == [("A", "x"), ("B", "x"), ("C", "z"), ("D", "x")]
    with pytest.raises(ValueError):
        decide.apply_rule(df, "expected_f05")
    with pytest.raises(ValueError):
        decide.apply_rule(df, "other")


def state(p, t):
    n = len(p)
    return [p[t], t / 15, sum(p[:t]) / max(t, 1), sum(p[t:]), p[0] - p[t], p[t] - (p[t + 1] if t + 1 < n else 0.0), n / 15]


def test_policy_follows_a_loop(spark):
    rng = np.random.default_rng(2)
    weights = policy.initial(8, 3) | {"b2": 0.4}
    groups = {f"G{i}": sorted(rng.random(rng.integers(1, 21)).round(4).tolist(), reverse=True) for i in range(30)}
    df = spark.createDataFrame([(g, f"{k:02d}", float(p)) for g, ps in groups.items() for k, p in enumerate(ps)], SCORED)
    for r in decide.policy_states(df).collect():
        assert [r[c] for c in decide.STATE] == pytest.approx(state(groups[r["source1_entity_id"]], r["rank"] - 1))
    want = {}
    for g, p in groups.items():
        k = 0
        while k < min(len(p), 15) and policy._continue(weights, np.array([state(p, k)]))[0][0] >= 0.5:
            k += 1
        want[g] = k
    kept = dict(rows(decide.policy_greedy(df, weights).groupBy("source1_entity_id").count(), "source1_entity_id", "count"))
    assert {g: kept.get(g, 0) for g in groups} == want


def test_policy_gradient_is_exact():
    rng = np.random.default_rng(0)
    sample = [(rng.random((n, 7)), rng.random(n + 1)) for n in (1, 3, 6)]
    weights = policy.initial(5, 1)
    found = policy.gradient(weights, sample, entropy=0.0)
    for key in ("w1", "b1", "w2"):
        flat = weights[key].ravel()
        for i in rng.choice(flat.size, 4):
            moved = {s: {**weights, key: (flat + s * np.eye(flat.size)[i]).reshape(weights[key].shape)} for s in (1e-6, -1e-6)}
            slope = (policy.expected(moved[1e-6], sample) - policy.expected(moved[-1e-6], sample)) / 2e-6
            assert found[key].ravel()[i] == pytest.approx(slope, abs=1e-6)
    many = policy.sampled_update(weights, sample, rollouts=40_000)
    assert many["w2"] == pytest.approx(found["w2"], abs=0.02)
    trained = policy.train(sample, epochs=60)
    assert policy.expected(trained, sample) > policy.expected(policy.initial(), sample)
    log = []
    sampled = policy.train(sample, epochs=40, rollouts=8, log=log)
    assert len(log) == 40 and log[-1] == policy.expected(sampled, sample) > policy.expected(policy.initial(), sample)
    again = policy.loads(policy.dumps(trained))
    assert policy.expected(again, sample) == pytest.approx(policy.expected(trained, sample))


def f05(pred, true):
    if not pred or not true:
        return float(not pred and not true)
    return 1.25 * len(pred & true) / (len(pred) + 0.25 * len(true))


def test_metrics(spark):
    pairs = lambda d: spark.createDataFrame([(a, b) for a, bs in d.items() for b in bs], "source1_entity_id string, other_id string")
    pred, true = {"A": "xy", "B": "x", "E": "q"}, {"A": "x", "C": "x", "B": "xy"}
    ids = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    want = {x: f05(set(pred.get(x, "")), set(true.get(x, ""))) for x in "ABCDE"}
    assert dict(rows(metrics.entity_scores(pairs(pred), pairs(true), ids), "source1_entity_id", "f05")) == pytest.approx(want)
    assert want["A"] == pytest.approx(0.5555555) and want["B"] == pytest.approx(0.8333333)
    r = metrics.macro_report(pairs(pred), pairs(true), ids).first()
    assert (r["n_s1"], r["n_singletons"], r["singleton_accuracy"]) == (5, 2, 0.5) and r["macro_f05"] == pytest.approx(np.mean(list(want.values())))
    assert metrics.macro_report(pairs(pred), pairs(true), metrics.population(ids, pairs(pred))).first()["n_s1"] == 3
    assert len(metrics.TREE_GRID) == 46 and len(metrics.NEURAL_GRID) == 17


def test_sweeps_follow_single_reports(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"S{i % 7}", f"{i}", round(float(rng.random()), 3)) for i in range(60)], SCORED)
    true = df.where("score > 0.55 or other_id in ('3', '8')").select("source1_entity_id", "other_id")
    ids = spark.createDataFrame([(f"S{i}",) for i in range(9)], "id string")
    for r in metrics.threshold_sweep(df, true, ids, [0.2, 0.5, 0.8]).collect():
        assert r["macro_f05"] == pytest.approx(metrics.macro_report(decide.threshold(df, r["threshold"]), true, ids).first()["macro_f05"])
    for exclusive, rule in ((False, decide.expected_f05), (True, decide.one_to_one_expected_f05)):
        for r in decide.lambda_grid(df, true, ids, [0.0, 1.0], exclusive).collect():
            assert r["macro_f05"] == pytest.approx(metrics.macro_report(rule(df, r["lambda"]), true, ids).first()["macro_f05"])


def test_id_lists_and_checks(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "x", 0.5), ("A", "x", 0.4), ("A", "y", 0.9)], SCORED)
    ids = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    lists = files.id_lists(pairs, ids, "matched_entity_ids")
    assert rows(lists, "source1_entity_id", "matched_entity_ids") == [("A", "y,x"), ("B", "")]
    files.write_id_lists(lists, str(tmp_path / "m"), one_file=True)
    text = next((tmp_path / "m").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nA\ty,x\nB\t\n"
    back = files.read_id_lists(spark, str(tmp_path / "m"), "matched_entity_ids")
    assert rows(back, "source1_entity_id", "ids") == [("A", ["y", "x"]), ("B", [])]
    bad = spark.createDataFrame([("A", ["x", "x", "q"]), ("Z", ["y"])], "source1_entity_id string, ids array<string>")
    known = spark.createDataFrame([("x",), ("y",)], "id string")
    found = validate.issues(bad, back, ids, known, strict=True)
    assert rows(found, "check", "source1_entity_id") == sorted(
        [("duplicate id in matches", "A"), ("match of unknown id", "A"), ("match without candidate", "A"), ("match without candidate", "Z"), ("missing from matches", "B"), ("unknown source-1 id in matches", "Z")]
    )
    n, shown = validate.report(found, 2)
    assert n == 6 and len(shown) == 2
    assert validate.report(validate.issues(back, back, ids, known)) == (0, [])


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('country\tentity_id\tbusiness_name\tbusiness_address\tmore\nUS\t1\t"A ""B""\tC"\tNA\tz\n\t2\t\t\t\n')
    found = files.read_records(spark, str(tmp_path / "a.tsv"))
    assert rows(found, "entity_id", "business_name", "business_address", "country") == [("1", 'A "B"\tC', "NA", "US"), ("2", "", "", "")]
    (tmp_path / "b.tsv").write_text("entity_id\tcountry\n1\tUS\n")
    with pytest.raises(ValueError, match="business_name"):
        files.read_records(spark, str(tmp_path / "b.tsv"))
    truth = spark.createDataFrame([("A", "x, y,,x"), ("B", ""), ("C", None)], "source1_entity_id string, matched_entity_ids string")
    assert rows(files.truth_pairs(truth), "source1_entity_id", "other_id") == [("A", "x"), ("A", "y")]
    files.write_sidecar(spark, {"a": 0.5}, str(tmp_path / "s"))
    assert files.read_sidecar(spark, str(tmp_path / "s")) == {"a": 0.5}


def test_labels(spark):
    df = spark.createDataFrame([(f"S{i}", "x") for i in range(400)], "source1_entity_id string, other_id string")
    share = labels.split(df, 0.3).agg(F.avg(F.col("held_out").cast("int"))).first()[0]
    assert 0.2 < share < 0.4
    assert labels.sample_ids(df, 50).count() == 50 and labels.sample_ids(df, 1000).count() == 400
    yes = df.limit(3)
    found = labels.label(df, yes)
    assert found.agg(F.sum("label")).first()[0] == 3
    weights = {r["label"]: (r["n"], r["weight"]) for r in labels.class_weights(found).collect()}
    assert weights == {1: (3, pytest.approx(400 / 6)), 0: (397, pytest.approx(400 / 794))}
    empty = df.limit(0)
    assert labels.recall_ceiling(df, empty).first()["recall"] == 1.0


def test_trigrams():
    assert neural.trigrams("") == ["^$"] and neural.trigrams("a") == ["^a$"] and neural.trigrams("ab") == ["^ab", "ab$"]


def test_neural_gradients_and_round_trip():
    rng = np.random.default_rng(4)
    m = neural.Matcher(n_aux=2, seed=1, buckets=64, width=3, hidden=4)
    fields = [["ab", "cd", "aa"], ["ab", "cx", "aa"], ["1 st", "", "x"], ["1 st", "2", "x"]]
    aux, y, groups = rng.random((3, 2)).astype(np.float32), np.array([1.0, 0.0, 1.0]), np.array([0, 0, 1])
    for k in m.params:
        m.params[k] = m.params[k].astype(np.float64)
    _, grads = m.gradients(fields, aux, y, groups)
    for key in ("table", "fc", "gate", "out", "fc_b"):
        flat = m.params[key]
        at = [tuple(i) for i in np.argwhere(np.abs(grads[key]) > 1e-4)[:3]]
        for i in at:
            old, losses = flat[i], []
            for s in (1e-3, -1e-3):
                flat[i] = old + s
                losses.append(m.gradients(fields, aux, y, groups)[0])
            flat[i] = old
            assert grads[key][i] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.1, abs=2e-3)
    again = neural.Matcher.loads(m.dumps())
    assert again.predict(fields, aux) == pytest.approx(m.predict(fields, aux))


def test_models_learn(spark, relations, candidates, sf):
    left, right = features.record_lookup(relations[0]), features.record_lookup(relations[1].unionByName(relations[2]))
    truth = files.truth_pairs(fixtures.relation(spark, sf, "fx_ground_truth"))
    rated = labels.label(features.with_fields(features.compute_features(candidates, left, right), left, right), truth)
    rated = rated.persist()
    fitted = model.fit(rated, rounds=3, depth=2)
    mean = model.score(fitted, rated).groupBy("label").agg(F.avg("score").alias("s"))
    s = dict(rows(mean, "label", "s"))
    assert s[1] > s[0] + 0.2
    matcher, losses = neural.fit(rated, epochs=3)
    assert losses[-1] < losses[0]
    scored = neural.score(matcher, rated)
    assert scored.columns[-1] == "score" and scored.count() == rated.count()


def test_trigram_buckets_are_the_columns(spark):
    """The matcher's buckets are those of the column that SQL is held against."""
    names = ["", "a", "ab sons & co", "é한", "x" * 50]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    told = [r["b"] for r in df.select("i", neural.bucket_column(F.col("name")).alias("b")).orderBy("i").collect()]
    flat, begins = neural.trigram_buckets(names)
    assert [x.tolist() for x in np.split(flat, begins[1:])] == told
