"""What spares queries on candidates time: tables are made at once, tasks follow the classes, texts are cleaned by fewer expressions, windows compared together."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity, text
from linkwright.operators import blocking, classes
from linkwright.plans import queries

RECORD = "entity_id string, business_name string, business_address string, country string"
FASTER = [
    "d_expected_f05",
    "d_one_to_one_expected_f05",
    "d_one_to_one_threshold",
    "d_policy_greedy",
    "d_policy_state",
    "d_threshold",
    "f_addr_jaccard",
    "f_addr_partial",
    "f_addr_len_diff",
    "f_all",
    "f_addr_token_sort",
    "f_country_match",
    "f_jaccard",
    "f_partial",
    "f_token_sort",
    "g_calibrated",
    "f_len_diff",
]


@pytest.mark.parametrize("name", FASTER)
def test_sources_are_prepared_at_once(spark, sf, monkeypatch, name):
    both, plain = threading.Barrier(2, timeout=30), blocking.materialize

    def together(df, label):
        if label in ("source1", "reference"):
            both.wait()
        return plain(df, label)

    for module in (blocking, queries):
        monkeypatch.setattr(module, "materialize", together)
    monkeypatch.setattr(blocking, "best_of_buckets", lambda one, both, *_: one.select(F.col("entity_id").alias("source1_entity_id"), F.lit("S2-1").alias("other_id"), F.lit("S2").alias("source"), F.lit(0.5).alias("name_cosine_sim")))
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan


def test_tasks_follow_classes(spark, monkeypatch):
    records = spark.createDataFrame([(f"R{i}", f"acme {i}", "", "US") for i in range(40)], RECORD)
    p = blocking.prepared(records)
    left, right = classes.left_classes(p), classes.right_classes(p.withColumn("source", F.lit("S2")))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert classes.units(left, right).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        monkeypatch.setattr(classes, "TASK_ROWS", 4)
        assert classes.units(left, right).rdd.getNumPartitions() == (left.count() + right.count()) // 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_records_are_cleaned_by_few_expressions(spark):
    plan = blocking.prepared(spark.createDataFrame([("A", "a", "b", "c")], RECORD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 6  # name, address, country once each, and the sound key's


def test_clean_of_odd_texts(spark):
    found = {
        "none!": "none", " \tNaN\n": "", "　nOnE ": "", "\x1cnone\x85": "", "none none": "none none", "nan\n\n": "", "!!": "", " ": "", "": "",
        "A\x1cB\x85C D": "a b c d", "A&B&&C": "a and b and and c", "x__y-z": "x__y z", "É½ ﬁn": "e1 2 fin", "ß 한 ٣": "ß \u1112\u1161\u11ab ٣", "​q": "q", "nonе": "nonе", None: "",
    }
    rows = spark.createDataFrame([(k,) for k in found], "v string").select("v", text.clean(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == found


def _lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _partial(x, y):
    if x == y:
        return 100.0
    if not x or not y:
        return 0.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    n = len(x)
    windows = [y[i : i + n] for i in range(len(y) - n + 1)] + [y[:k] for k in range(1, n)] + [y[-k:] for k in range(1, n)]
    best = max(200.0 * _lcs(x, w) / (n + len(w)) for w in windows)
    if len(y) == n:
        best = max(best, *(200.0 * _lcs(y, w) / (n + len(w)) for w in [x[:k] for k in range(1, n)] + [x[-k:] for k in range(1, n)] + [x]))
    return best


@pytest.mark.parametrize("most", [1, 1 << 22])
def test_windows_are_compared_together(monkeypatch, most):
    """Against dynamic programming, with masks that must be halved; equal pairs once, a text's masks once."""
    monkeypatch.setattr(similarity, "MAX_MASKS", most)
    chance = random.Random(7)
    word = lambda letters, n: "".join(chance.choice(letters) for _ in range(n))
    texts = ["", "a", "ab", "b" * 70] + [word("abc", chance.randrange(1, 12)) for _ in range(12)] + [word("abcdé한", n) for n in (5, 5, 63, 64, 65, 66, 130)]
    pairs = [(x, y) for x in texts for y in texts]
    made, plain = [], similarity._numbered
    monkeypatch.setattr(similarity, "_numbered", lambda t, i, j, words, back=False: made.append(len(i)) or plain(t, i, j, words, back))
    found = similarity.partial_ratios([x for x, _ in pairs], [y for _, y in pairs])
    assert found.tolist() == [_partial(x, y) for x, y in pairs]
    if most > 1:
        once = sum(made)
        made.clear()
        again = similarity.partial_ratios([x for x, _ in pairs] * 5, [y for _, y in pairs] * 5)
        assert sum(made) == once and (again == np.tile(found, 5)).all()
