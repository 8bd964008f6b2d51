"""What spares queries on candidates time: records are normalised in batches with the results of the expressions, classes need no second sort, tokens meet in batches."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from linkwright.functions import lexicon, plain, similarity, text
from linkwright.operators import blocking, classes
from linkwright.plans import queries

RECORD = "entity_id string, business_name string, business_address string, country string"
ODD = [None, "", " ", "\tnone\n", "NaN ", "none none", "A&B&&C Corporation", "x__y-z and Sons Company", "É½ ﬁn 한국", "İstanbul ΣΑΣ ẞ", "\x1cnone\x85", "Opposite the Street 12, 0044 Saint 7 1234", "٣٤ rd 12345 99999", "Tszczyk bfpv", "aeiou 1", "_ Ashcraft", "U.S.A.", " in\n", "FR", "9 next to Opp"]


def by_expressions(records):
    rows = records.withColumn("_n", text.clean(F.col("business_name"))).withColumn("_a", text.clean(F.col("business_address"))).withColumn("_c", text.normalize_country(F.col("country")))
    rows = rows.withColumns({"name": text.name_of(F.col("_n")), "addr": text.address_of(F.col("_a")), "area": F.when(F.col("_c") == "", lexicon.UNKNOWN_COUNTRY).otherwise(F.col("_c")), "house": text.house_number(F.col("_a")), "post": text.postcode(F.col("_a"))})
    name = F.col("name")
    last = (text.name_prefix(name, 4), text.digit_key(F.col("addr")), F.col("post"), F.concat_ws("|", "house", text.name_prefix(name, 2)), text.sound_key(text.first_token(name)))
    return rows.withColumn("keys", F.array(*(F.concat_ws("|", "area", x) for x in last))).drop("_n", "_a", "_c")


def test_records_are_normalised_as_by_expressions(spark):
    chance = random.Random(3)
    words = [w for t in ODD if t for w in t.split(" ")] + list(lexicon.NAME_WORDS) + list(lexicon.ADDRESS_WORDS)
    some = lambda: chance.choice(ODD) if chance.random() < 0.3 else " ".join(chance.choices(words, k=chance.randrange(1, 7)))
    records = spark.createDataFrame([(f"R{i}", some(), some(), some()) for i in range(1500)], RECORD)
    found, expected = blocking.prepared(records), by_expressions(records)
    assert found.columns == expected.columns and [t for _, t in found.dtypes] == [t for _, t in expected.dtypes]
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert blocking.prepared(found.limit(0)).columns == found.columns


def test_every_character_is_cleaned_as_by_expressions(spark):
    """Characters that this Java does not know yet are left out."""
    codes = [c for c in range(1, sys.maxunicode + 1, 3) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}B") for c in codes], "code int, v string")
    differ = [r.code for r in rows.select("code", "v", text.clean(F.col("v")).alias("c")).collect() if plain.clean(r.v) != r.c]
    assert not [c for c in differ if spark._jvm.java.lang.Character.isDefined(c)]


def test_ids_of_classes_are_collected_in_one_sort(spark):
    rows = [(f"R{i:03}", f"acme {i % 3}", "", "US") for i in range(60)] + [("Q", "acme 1", "", "US")]
    right = classes.right_classes(blocking.prepared(spark.createDataFrame(rows, RECORD).withColumn("source", F.lit("S2"))), 4)
    plan = right._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "ObjectHashAggregate" not in plan
    found = {r["text"]: (r["n"], r["ids"]) for r in right.where("key_type = 0").collect()}
    assert found == {" ".join(sorted(["acme", str(j)])): (4, (["Q"] if j == 1 else []) + [f"R{i:03}" for i in range(j, 60, 3)][: 3 if j == 1 else 4]) for j in range(3)}


def test_units_of_a_key_type_stay_together(spark):
    p = blocking.prepared(spark.createDataFrame([(f"R{i}", f"acme{i % 7} {i}", f"{i} street {1000 + i % 5}", "US") for i in range(80)], RECORD))
    left, right = classes.left_classes(p), classes.right_classes(p.withColumn("source", F.lit("S2")))
    rows = classes.units(left, right).select(F.spark_partition_id().alias("p"), *classes.UNIT, "is_right").collect()
    for part in {r["p"] for r in rows}:
        some = [r for r in rows if r["p"] == part]
        assert [r["key_type"] for r in some] == sorted(r["key_type"] for r in some)
        runs = [tuple(a[1:5]) for a, b in zip(some, [None, *some], strict=False) if b is None or a[1:5] != b[1:5]]
        assert len(runs) == len(set(runs))


def test_jaccard_of_pairs():
    chance = random.Random(5)
    texts = ["", "a", "a a", "é 한 a", *(" ".join(sorted(chance.choices("abcdefgh", k=chance.randrange(1, 7)))) for _ in range(30))]
    pairs = [(x, y) for x in texts for y in texts] * 2
    plain_one = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    assert similarity.token_jaccards([x for x, _ in pairs], [y for _, y in pairs]).tolist() == [plain_one(set(x.split()), set(y.split())) for x, y in pairs]
    assert similarity.token_jaccards([], []).tolist() == [] and similarity.token_jaccards([""], [""]).tolist() == [1.0]


@pytest.mark.parametrize("name", ["f_jaccard", "f_addr_jaccard", "f_all", "d_threshold"])
def test_tokens_do_not_go_through_joins(spark, sf, name, monkeypatch):
    monkeypatch.setattr(blocking, "best_of_buckets", lambda one, both, *_: one.select(F.col("entity_id").alias("source1_entity_id"), F.lit("S2-1").alias("other_id"), F.lit("S2").alias("source"), F.lit(0.5).alias("name_cosine_sim")))
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_distinct" not in plan
