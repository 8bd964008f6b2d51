"""What keeps queries on candidates short at size: few pairs are compared, lists are merged without pair rows, texts are taken apart once per record."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity
from linkwright.operators import blocking, classes, features
from linkwright.plans import oracle, queries

RECORD = "entity_id string, business_name string, business_address string, country string"
ON_CANDIDATES = ["f_token_sort", "f_addr_token_sort", "f_jaccard", "f_addr_jaccard", "f_all", "d_threshold", "d_one_to_one_threshold", "d_expected_f05", "d_one_to_one_expected_f05", "d_policy_state", "d_policy_greedy"]


def test_hopeless_pairs_are_not_compared(spark, monkeypatch):
    """Of 720 names with one key, those that cannot be among the best two are left out by the characters they share."""
    words = ["".join(w) for w in itertools.permutations(["bolt ", "gear ", "ring ", "quiz ", "mynx ", "sold "])]
    many = [(f"R{i:04}", f"acme {w[: 10 + i % 20]}", "", "US") for i, w in enumerate(words)]
    one = spark.createDataFrame([("A", "acme bolt gear ring", "", "US"), ("B", "acme quiz mynx", "", "US")], RECORD)
    p1, p2 = blocking.prepared(one), blocking.prepared(blocking.tagged(spark.createDataFrame(many, RECORD), spark.createDataFrame([], RECORD)))
    left, right = ([r.asDict() for r in df.where("key_type = 0").collect()] for df in (classes.left_classes(p1), classes.right_classes(p2, 2)))
    rows = [{**r, "is_right": False, "source": "", "ids": []} for r in left] + [{**r, "is_right": True} for r in right]
    table = classes.pa.Table.from_pylist([{**r, "left_block": 0, "right_block": 0} for r in rows])
    compared, plain = [], similarity.common_lengths
    monkeypatch.setattr(similarity, "common_lengths", lambda texts, i, j: compared.append(len(i)) or plain(texts, i, j))
    whole = {(a, b): (c, t) for x in classes._met(table, np.array([0]), 55.0) for a, b, c, t in zip(*x, strict=True)}
    every, compared[:] = sum(compared), []
    some = {(a, b): (c, t) for x in classes._met(table, np.array([0]), 55.0, 2) for a, b, c, t in zip(*x, strict=True)}
    assert sum(compared) < every / 2 and some.items() <= whole.items()
    for a in (0, 1):
        scores = sorted((200 * c / t for (x, b), (c, t) in whole.items() if x == a for _ in range(rows[b]["n"])), reverse=True)
        best = {p for p, (c, t) in whole.items() if p[0] == a and 200 * c / t >= scores[1]}
        assert best
        assert best <= some.keys()
    expected = blocking.best_candidates(blocking.scored_pairs(blocking.bucket_pairs(p1, p2)), 2)
    assert sorted(map(tuple, blocking.best_of_buckets(p1, p2, 2).collect())) == sorted(map(tuple, expected.collect()))


def test_bound_of_shared_characters(monkeypatch):
    texts = ["", "aab", "abab", "bé한\U0001f600", "\U0001f600한", "zz" * 300, "a\0b"]
    i, j = (np.array(x) for x in zip(*itertools.product(range(len(texts)), repeat=2), strict=True))
    common = similarity.common_lengths(texts, i, j)
    bound = similarity.Shared(texts).bound(i, j)
    assert (bound >= common).all() and bound[1 * 7 + 2] == 3 and bound[3 * 7 + 4] == 2
    monkeypatch.setattr(similarity, "MAX_BITS_WORDS", 0)
    assert (similarity.Shared(texts).bound(i, j) >= common).all()
    assert similarity.Shared([]).bound(i[:0], j[:0]).tolist() == []


@pytest.mark.parametrize("rows", [1, 5, 16384])
def test_lists_are_merged_like_pairs(spark, monkeypatch, rows):
    """Ids that occur more than once, also without a value, in batches that end within an id."""
    monkeypatch.setattr(classes, "ROWS", rows)
    best = [[(f"S{o % 2}", f"x{o:03}", (o * 7 + i) % 5 / 5) for o in range(i % 4, 40, 1 + i % 4)] for i in range(30)]
    lists = spark.createDataFrame([(None if i % 10 == 3 else f"id{i % 10}", b) for i, b in enumerate(best)], "source1_entity_id string, best array<struct<source:string,other_id:string,score:double>>")
    pairs = lists.select("source1_entity_id", F.inline("best")).select("source1_entity_id", "other_id", "source", F.col("score").alias("name_cosine_sim"))
    found, expected = classes.best_of_lists(lists, 3), blocking.best_candidates(pairs, 3)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ON_CANDIDATES)
def test_texts_are_taken_apart_once_per_record(spark, sf, name, monkeypatch):
    monkeypatch.setattr(blocking, "best_of_buckets", lambda one, both, *_: one.select(F.col("entity_id").alias("source1_entity_id"), F.concat(F.lit("S2-"), F.lit("1")).alias("other_id"), F.lit("S2").alias("source"), F.lit(0.5).alias("name_cosine_sim")))
    lines = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(lines) if "Join" in x]
    assert any("split(" in x for x in lines) and not any("split(" in x for x in lines[: joins[-1]])


def test_parts_of_missing_records(spark):
    rows = spark.createDataFrame([("A", "acme b acme", "2 x 1", "US")], "entity_id string, name string, addr string, country string")
    pairs = spark.createDataFrame([("A", "R"), ("Q", "A")], "source1_entity_id string, other_id string")
    a, q = features.with_fields(pairs, rows, rows, parts=True).orderBy("source1_entity_id").collect()
    assert (a["name_sorted_a"], a["addr_tokens_a"], a["name_tokens_b"], a["addr_sorted_b"]) == ("acme acme b", ["2", "x", "1"], [], "")
    assert (q["name_tokens_a"], q["country_a"], q["addr_sorted_b"]) == ([], "", "1 2 x")


def test_equal_pairs_are_compared_once(monkeypatch):
    compared, plain = [], similarity.common_lengths
    monkeypatch.setattr(similarity, "common_lengths", lambda texts, i, j: compared.append(len(i)) or plain(texts, i, j))
    found = similarity.indel_ratios(["abc", "", "abc", "abcd", ""] * 100, ["abd", "", "abd", "xbd", "q"] * 100)
    assert compared == [4] and found[:5].tolist() == [100 * 4 / 6, 100, 100 * 4 / 6, 100 * 4 / 7, 0]


@pytest.mark.parametrize("name", ["b_candidate_counts", "f_len_diff", "f_addr_len_diff", "f_country_match"])
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.sql(oracle.ORACLE[name]).df()[list(queries.QUERIES[name](spark, sf).columns)]
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
