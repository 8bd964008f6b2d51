"""Keys that many records have: every pair counts, and none goes through the driver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity
from linkwright.operators import blocking, classes, features
from linkwright.session import materialize
from linkwright.sources import fixtures

RECORD = "entity_id string, business_name string, business_address string, country string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def crowd(spark):
    """Two records and 1,600 references that share name keys."""
    one = records(spark, [("A", "acme corp", "", "US"), ("B", "acme ltd", "7 Main St 12345", "US")])
    many = spark.range(1600).select(F.concat(F.lit("R"), "id").alias("entity_id"), F.lit("acme corp").alias("business_name"), F.lit("").alias("business_address"), F.lit("USA").alias("country"))
    return one, many, records(spark, [])


def test_large_buckets_count_whole(spark, crowd):
    one, many, none = crowd
    p1, p2 = blocking.prepared(one), blocking.prepared(blocking.tagged(many, none))
    assert sorted(map(tuple, blocking.shared_key_counts(p1, p2).collect())) == [("S2", 0, 3200), ("S2", 3, 1600), ("S2", 4, 3200)]  # without a house number, only the first meets at that key
    assert blocking.shared_keys(p1, p2).count() == 8000
    assert blocking.shared_key_counts(p1, p2, 1500).count() == 0  # a bound that is asked for holds


@pytest.mark.parametrize("cap", [None, 10])
def test_pairs_do_not_pass_the_driver(spark, crowd, tmp_path, cap):
    """Small files do not tell how many exploded rows they hold: neither side is sent to the driver to be broadcast."""
    one, many, none = crowd
    for name, df in (("one", blocking.prepared(one)), ("many", blocking.prepared(blocking.tagged(many, none)))):
        df.write.parquet(f"{tmp_path}/{name}")
    plan = blocking.bucket_pairs(spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/many"), cap)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def plain_best(spark, one, both, k):
    return sorted(map(tuple, blocking.best_candidates(blocking.scored_pairs(blocking.bucket_pairs(one, both)), k).collect()))


@pytest.mark.parametrize("left_block,right_block,rows,pairs", [(1024, 4096, 16384, 1 << 20), (3, 4, 7, 10)])
def test_best_of_classes_equal_best_of_pairs(spark, sf, monkeypatch, left_block, right_block, rows, pairs):
    """Also with keys dealt to many blocks, ids that two sources or two records share, and records without a name."""
    for name, value in (("LEFT_BLOCK", left_block), ("RIGHT_BLOCK", right_block), ("ROWS", rows), ("PAIRS", pairs)):
        monkeypatch.setattr(classes, name, value)
    s1, s2, s3 = fixtures.sources(spark, sf)
    odd = records(spark, [("S2-1", "bolt acme corp", "1 Main St 12345", "US"), ("S2-1", "acme bolt", "9 Main St 12345", "US"), ("N1", "", "1 Main St 12345", "US"), ("N2", None, "1 Main St 12345", "US")])
    s3 = s3.unionByName(odd).unionByName(s2.where("entity_id like '%4'"))
    s1 = s1.unionByName(records(spark, [("S1-1", "acme bolt", "1 Main St 12345", "US"), ("S1-0", "", "1 Main St 12345", "US")]))
    one, both = materialize(blocking.prepared(s1), "one"), blocking.prepared_reference(s2, s3)
    for k in (1, 3):
        assert sorted(map(tuple, blocking.best_of_buckets(one, both, k).collect())) == plain_best(spark, one, both, k)
    pairs = blocking.scored_pairs(blocking.bucket_pairs(one, both)).groupBy("source").agg(F.count(F.lit(1)), F.round(F.sum("name_cosine_sim"), 6))
    assert sorted(map(tuple, blocking.score_totals(one, both).withColumn("total", F.round("total", 6)).collect())) == sorted(map(tuple, pairs.collect()))


def test_equal_names_are_compared_once(spark, crowd, monkeypatch):
    """3,200 pairs of records by name, two pairs of names: the kernel sees the latter."""
    one, many, none = crowd
    left, right = classes.left_classes(blocking.prepared(one)), classes.right_classes(blocking.prepared(blocking.tagged(many, none)), 3)
    assert right.where("key_type = 0").count() == 1 and right.agg(F.max(F.size("ids"))).first()[0] == 3
    assert classes.units(left, right).where("key_type = 0").count() == 3
    found = blocking.generate_candidates(one, many, none, top_k=2)
    assert sorted((r["source1_entity_id"], r["other_id"]) for r in found.collect()) == [("A", "R0"), ("A", "R1"), ("B", "R0"), ("B", "R1")]
    total = {r["source"]: (r["pairs"], round(r["total"], 6)) for r in blocking.score_totals(blocking.prepared(one), blocking.prepared(blocking.tagged(many, none))).collect()}
    ratio = similarity.indel_ratios(["acme corp"], ["acme ltd"])[0] / 100
    assert total == {"S2": (3200, round(1600 * (1 + ratio), 6))}


def test_common_lengths(monkeypatch):
    """Against the kernel that takes pair by pair; masks that would be large are made in parts."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd é한") for _ in range(rng.choice([0, 1, 30, 64, 65, 140]))) for _ in range(80)]
    i, j = (np.array([rng.randrange(80) for _ in range(3000)]) for _ in "ij")
    expected = similarity.lcs_lengths([texts[x] for x in i], [texts[x] for x in j]).tolist()
    for masks in (1 << 22, 200):
        monkeypatch.setattr(similarity, "MAX_MASKS", masks)
        assert similarity.common_lengths(texts, i, j).tolist() == expected


def test_lookups_do_not_normalise_again(spark, crowd):
    one = crowd[0].unionByName(records(spark, [("C", "Énergie & Sons Limited", "5 Saint-Jean Street", " USA ")]))
    again = features.prepared_lookup(blocking.prepared(one).drop("business_name", "business_address"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, features.record_lookup(one).collect()))
