"""Registered queries: each operator over the fixture relations (see sources.fixtures)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import blocking, decide, extra, features, labels, metrics, model, neural, policy, validate
from ..session import materialize
from ..sources import files, fixtures

CAP = 10  # buckets of the fixture are small; this makes the cap bind
GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
LAMBDAS = [0.0, 0.3, 1.0]
HIDDEN = 8

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def fixed_weights(hidden: int = HIDDEN) -> dict:
    """A policy network without training, for queries: short decimals that differ from each other."""
    wave = lambda i, k: round(math.sin(1 + 3 * i + 7 * k), 3)
    return {"w1": [[wave(i, k) for k in range(hidden)] for i in range(len(decide.STATE))], "b1": [wave(20, k) for k in range(hidden)], "w2": [wave(40, k) for k in range(hidden)], "b2": 2.25}


# ---- relations that queries start from


def everyone(spark: SparkSession, sf: str) -> DataFrame:
    """All records with a source column."""
    s1, s2, s3 = fixtures.sources(spark, sf)
    return s1.withColumn("source", F.lit("S1")).unionByName(blocking.tagged(s2, s3))


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return blocking.prepared_sources(*fixtures.sources(spark, sf))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.generate_candidates(*fixtures.sources(spark, sf))


def fielded(spark: SparkSession, sf: str, parts: bool = False) -> DataFrame:
    one, both = prepared(spark, sf)
    return features.with_fields(blocking.best_of_buckets(one, both), features.prepared_lookup(one), features.prepared_lookup(both), parts)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the formula score."""
    f = F.col
    rated = fielded(spark, sf, parts=True).withColumn("name_token_sort_ratio", f("name_cosine_sim"))
    rated = rated.withColumn("addr_token_sort_ratio", similarity.indel_ratio("addr_sorted_a", "addr_sorted_b") / 100)
    rated = rated.withColumns({f"{c}_jaccard": similarity.pair_jaccard(f"{c}_sorted_a", f"{c}_sorted_b") for c in ("name", "addr")})
    return features.formula_score(rated).select("source1_entity_id", "other_id", "source", "score")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return files.truth_pairs(fixtures.relation(spark, sf, "fx_ground_truth"))


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.relation(spark, sf, "fx_source1").select("entity_id")


# ---- normalisation


def _scalar(name: str, column, of: str = "business_address"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        odd = fixtures.relation(spark, sf, "fx_odd").withColumn("source", F.lit("odd"))
        return everyone(spark, sf).unionByName(odd).select("entity_id", column(F.col(of)).alias("value"))

    QUERIES[name] = run


_scalar("n_clean", text.clean, "business_name")
_scalar("n_name", text.normalize_name, "business_name")
_scalar("n_address", text.normalize_address)
_scalar("n_country", text.normalize_country, "country")
_scalar("n_house_number", lambda c: text.house_number(text.clean(c)))
_scalar("n_postcode", lambda c: text.postcode(text.clean(c)))
_scalar("n_soundex", lambda c: text.sound_key(text.first_token(text.normalize_name(c))), "business_name")
_scalar("n_digit_key", lambda c: text.digit_key(text.normalize_address(c)))
_scalar("n_token_set", lambda c: F.array_join(F.array_sort(text.token_set(text.normalize_name(c))), " "), "business_name")
_scalar("n_plain_country", text.plain_country, "country")


# ---- blocking


@query
def b_keys(spark, sf):
    one, both = prepared(spark, sf)
    rows = one.withColumn("source", F.lit("S1")).select("source", "entity_id", "keys").unionByName(both.select("source", "entity_id", "keys"))
    return rows.select("source", "entity_id", F.posexplode("keys").alias("key_type", "key")).withColumn("key_type", F.col("key_type").cast("long"))


@query
def b_empty_key_filter(spark, sf):
    one, both = prepared(spark, sf)
    rows = one.withColumn("source", F.lit("S1")).select("source", "entity_id", "keys").unionByName(both.select("source", "entity_id", "keys"))
    return blocking.exploded(rows, "source").groupBy("source", "key_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).withColumn("key_type", F.col("key_type").cast("long"))


@query
def b_bucket_sizes(spark, sf):
    return blocking.oversized(prepared(spark, sf)[1], CAP).withColumn("key_type", F.col("key_type").cast("long"))


@query
def b_oversize_report(spark, sf):
    return blocking.oversize_report(*prepared(spark, sf), CAP)


@query
def b_bucket_join(spark, sf):
    return blocking.shared_key_counts(*prepared(spark, sf)).withColumn("key_type", F.col("key_type").cast("long"))


@query
def b_pair_dedup(spark, sf):
    return blocking.bucket_pairs(*prepared(spark, sf)).select("source1_entity_id", "other_id", "source")


@query
def b_capped_pairs(spark, sf):
    return blocking.bucket_pairs(*prepared(spark, sf), CAP).select("source1_entity_id", "other_id", "source")


@query
def b_score_floor(spark, sf):
    return blocking.score_totals(*prepared(spark, sf)).withColumn("total", F.round("total", 4))


@query
def b_topk(spark, sf):
    return blocking.best_of_buckets(*prepared(spark, sf), 3).withColumn("name_cosine_sim", F.round("name_cosine_sim", 6))


@query
def b_candidates(spark, sf):
    return candidates(spark, sf).withColumn("name_cosine_sim", F.round("name_cosine_sim", 6))


@query
def b_candidate_counts(spark, sf):
    return blocking.candidate_counts(candidates(spark, sf))


# ---- similarity and features


def _feature(name: str, column):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fielded(spark, sf, parts=True).select("source1_entity_id", "other_id", F.round(column(), 6).alias("value"))

    QUERIES[name] = run


_feature("f_token_sort", lambda: similarity.indel_ratio("name_sorted_a", "name_sorted_b") / 100)
_feature("f_addr_token_sort", lambda: similarity.indel_ratio("addr_sorted_a", "addr_sorted_b") / 100)
_feature("f_partial", lambda: similarity.partial_ratio("name_a", "name_b") / 100)
_feature("f_addr_partial", lambda: similarity.partial_ratio("addr_a", "addr_b") / 100)
_feature("f_jaccard", lambda: similarity.pair_jaccard("name_sorted_a", "name_sorted_b"))
_feature("f_addr_jaccard", lambda: similarity.pair_jaccard("addr_sorted_a", "addr_sorted_b"))
_feature("f_len_diff", lambda: similarity.length_difference(F.col("name_a"), F.col("name_b")))
_feature("f_addr_len_diff", lambda: similarity.length_difference(F.col("addr_a"), F.col("addr_b")))
_feature("f_country_match", lambda: similarity.country_match(F.col("country_a"), F.col("country_b")))


@query
def f_all(spark, sf):
    one, both = prepared(spark, sf)
    return features.compute_features(blocking.best_of_buckets(one, both), features.prepared_lookup(one), features.prepared_lookup(both))


@query
def f_formula_score(spark, sf):
    return scored(spark, sf)


# ---- joins, labels, splits


@query
def j_lookup_left(spark, sf):
    return fielded(spark, sf).select("source1_entity_id", "other_id", "name_a", "addr_a", "country_a", "name_b", "addr_b", "country_b")


@query
def j_label(spark, sf):
    return labels.label(candidates(spark, sf), truth(spark, sf)).select("source1_entity_id", "other_id", F.col("label").cast("long").alias("label"))


@query
def j_semi(spark, sf):
    return labels.keep_ids(truth(spark, sf), labels.sample_ids(ids(spark, sf), 100))


@query
def j_anti(spark, sf):
    return extra.without_ids(ids(spark, sf).withColumnRenamed("entity_id", "source1_entity_id"), candidates(spark, sf).select("source1_entity_id").distinct())


@query
def l_pairs_explode(spark, sf):
    return truth(spark, sf)


@query
def l_recall_ceiling(spark, sf):
    return labels.recall_ceiling(candidates(spark, sf), truth(spark, sf)).withColumn("recall", F.round("recall", 9))


@query
def l_split(spark, sf):
    return labels.split(ids(spark, sf), 0.2, by="entity_id")


@query
def l_sample(spark, sf):
    return labels.sample_ids(ids(spark, sf), 100)


@query
def l_class_weights(spark, sf):
    found = labels.class_weights(labels.label(candidates(spark, sf), truth(spark, sf)))
    return found.select(F.col("label").cast("long").alias("label"), "n", F.round("weight", 9).alias("weight"))


# ---- set operations


@query
def u_union_all(spark, sf):
    _, s2, s3 = fixtures.sources(spark, sf)
    return blocking.tagged(s2, s3).select("source", "entity_id", "business_name")


@query
def u_intersect(spark, sf):
    return candidates(spark, sf).select("source1_entity_id", "other_id").intersect(truth(spark, sf))


@query
def u_except(spark, sf):
    return truth(spark, sf).subtract(candidates(spark, sf).select("source1_entity_id", "other_id"))


@query
def u_distinct_ids(spark, sf):
    _, s2, s3 = fixtures.sources(spark, sf)
    return s2.select("entity_id").union(s3.select("entity_id")).distinct()


# ---- decisions


@query
def w_one_to_one(spark, sf):
    return decide.one_to_one(scored(spark, sf))


@query
def d_threshold(spark, sf):
    return decide.threshold(scored(spark, sf), 0.6)


@query
def d_one_to_one_threshold(spark, sf):
    return decide.one_to_one_threshold(scored(spark, sf), 0.6)


@query
def d_expected_f05(spark, sf):
    return decide.expected_f05(scored(spark, sf), 0.3)


@query
def d_one_to_one_expected_f05(spark, sf):
    return decide.one_to_one_expected_f05(scored(spark, sf), 0.3)


@query
def d_policy_state(spark, sf):
    rows = decide.policy_states(scored(spark, sf))
    return rows.select("source1_entity_id", "other_id", F.col("rank").cast("long").alias("rank"), *(F.round(c, 12).alias(c) for c in decide.STATE))


@query
def d_policy_greedy(spark, sf):
    return decide.policy_greedy(scored(spark, sf), fixed_weights()).select("source1_entity_id", "other_id", "score")


# ---- metrics


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query
def m_fbeta(spark, sf):
    return _rounded(metrics.entity_scores(decide.threshold(scored(spark, sf), 0.6), truth(spark, sf), ids(spark, sf)))


@query
def m_macro_report(spark, sf):
    return _rounded(metrics.macro_report(decide.threshold(scored(spark, sf), 0.6), truth(spark, sf), ids(spark, sf)))


@query
def m_macro_with_candidates(spark, sf):
    found = scored(spark, sf)
    return _rounded(metrics.macro_report(decide.threshold(found, 0.6), truth(spark, sf), metrics.population(ids(spark, sf), found)))


@query
def m_by_country(spark, sf):
    countries = fixtures.relation(spark, sf, "fx_source1").select(F.col("entity_id").alias("source1_entity_id"), text.normalize_country(F.col("country")).alias("country"))
    found = metrics.report_by_country(decide.threshold(scored(spark, sf), 0.6), truth(spark, sf), countries)
    return _rounded(found.withColumn("is_total", F.col("is_total").cast("long")))


@query
def m_threshold_sweep(spark, sf):
    return _rounded(metrics.threshold_sweep(scored(spark, sf), truth(spark, sf), ids(spark, sf)))


@query
def m_neural_grid_sweep(spark, sf):
    return _rounded(metrics.threshold_sweep(scored(spark, sf), truth(spark, sf), ids(spark, sf), metrics.NEURAL_GRID))


@query
def m_lambda_grid(spark, sf):
    return _rounded(decide.lambda_grid(scored(spark, sf), truth(spark, sf), ids(spark, sf)))


@query
def m_lambda_grid_one_to_one(spark, sf):
    return _rounded(decide.lambda_grid(scored(spark, sf), truth(spark, sf), ids(spark, sf), exclusive=True))


@query
def m_rule_comparison(spark, sf):
    return _rounded(decide.compare_rules(scored(spark, sf), truth(spark, sf), ids(spark, sf), 0.6, 0.3, 0.3))


# ---- outputs and checks


def _lists(spark, sf, rule) -> DataFrame:
    return files.id_lists(rule(scored(spark, sf)), ids(spark, sf), "ids")


@query
def s_id_list(spark, sf):
    return _lists(spark, sf, lambda d: decide.threshold(d, 0.6)).withColumnRenamed("ids", "matched_entity_ids")


def _spoilt(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Matches and candidates as parsed lists, with planted faults by the last digit of the id."""
    last = F.substring("source1_entity_id", -1, 1)
    split = lambda df: df.select("source1_entity_id", F.filter(F.split("ids", ","), lambda x: x != "").alias("ids"))
    cands = split(_lists(spark, sf, lambda d: d)).where(last != "7")
    cands = cands.withColumn("ids", F.when(last == "6", F.concat("ids", F.slice("ids", 1, 1))).otherwise(F.col("ids")))
    matches = split(_lists(spark, sf, lambda d: decide.threshold(d, 0.6))).where(last != "3")
    matches = matches.withColumn("ids", F.when(last == "4", F.concat("ids", F.slice("ids", 1, 1))).when(last == "5", F.concat("ids", F.array(F.lit("S9-1")))).otherwise(F.col("ids")))
    return matches, cands


@query
def v_missing(spark, sf):
    return validate.missing_ids(ids(spark, sf), _spoilt(spark, sf)[0])


@query
def v_duplicates(spark, sf):
    return validate.duplicate_ids(_spoilt(spark, sf)[0])


@query
def v_unknown_ids(spark, sf):
    return validate.unknown_ids(_spoilt(spark, sf)[0], u_distinct_ids(spark, sf))


@query
def v_not_in_candidates(spark, sf):
    return validate.not_candidates(*_spoilt(spark, sf))


@query
def v_report(spark, sf):
    matches, cands = _spoilt(spark, sf)
    found = validate.issues(matches, cands, ids(spark, sf), u_distinct_ids(spark, sf))
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


# ---- described extras


@query
def t_trigram_buckets(spark, sf):
    names = fixtures.relation(spark, sf, "fx_source1").select("entity_id", text.normalize_name(F.col("business_name")).alias("name"))
    return names.select("entity_id", F.array_join(F.transform(neural.bucket_column(F.col("name")), lambda b: b.cast("string")), ",").alias("buckets"))


@query
def x_tfidf_knn(spark, sf):
    found = extra.tfidf_neighbours(*prepared(spark, sf), k=15, floor=0.2)
    return found.select("source1_entity_id", "other_id", "source", "similarity")


@query
def x_rare_token(spark, sf):
    return extra.rare_token_pairs(*prepared(spark, sf))


@query
def x_embedding_knn(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))
    return extra.vector_neighbours(rows.where("id % 20 = 0"), rows, 10).select("left_id", "right_id", F.col("rank").cast("long").alias("rank"), "similarity")


@query
def x_embedding_passes(spark, sf):
    """Halves of a vector stand for name and address; ids divisible by 3 stand for records without one."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null")
    half = F.floor(F.size("embedding") / 2).cast("int")
    addr = F.when(F.col("vec_id") % 3 != 0, F.slice("embedding", half + 1, F.size("embedding") - half))
    rows = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("both"), F.slice("embedding", F.lit(1), half).alias("name"), addr.alias("addr"))
    return extra.vector_passes(rows.where("id % 20 = 0"), rows).select("pass", "left_id", "right_id", F.col("rank").cast("long").alias("rank"), "similarity")


@query
def x_name_key_pairs(spark, sf):
    return extra.name_key_pairs(*prepared(spark, sf)).withColumn("key_type", F.col("key_type").cast("long"))


@query
def x_pair_details(spark, sf):
    rows = extra.pair_details(fielded(spark, sf))
    return rows.select("source1_entity_id", "other_id", "house_match", "post_match", F.round("aligned_share", 9).alias("aligned_share"), "first_token_match", "plain_name_match", "same_house")


@query
def x_extra_keys(spark, sf):
    one, _ = prepared(spark, sf)
    return extra.extra_keys(one).select("entity_id", F.posexplode("keys").alias("key_type", "key")).where("key_type >= 5").withColumn("key_type", F.col("key_type").cast("long"))


@query
def x_competition(spark, sf):
    rows = extra.competition(scored(spark, sf))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("s1_rank", "s1_count", "other_rank", "other_count")})


@query
def x_agreement(spark, sf):
    return extra.agreement(scored(spark, sf))


@query
def x_relative_threshold(spark, sf):
    return decide.relative_threshold(scored(spark, sf), 0.9)


@query
def x_bucket_thresholds(spark, sf):
    table = spark.createDataFrame([(0, "S2", 0.4), (1, "S2", 0.5), (2, "S3", 0.7), (3, "S3", 0.8)], "bucket int, source string, threshold double")
    return decide.bucket_thresholds(scored(spark, sf), table, 0.6).select("source1_entity_id", "other_id", "source", "score")


@query
def x_pruner(spark, sf):
    return extra.pruned(scored(spark, sf), 5, 0.3)


@query
def x_uncertain_band(spark, sf):
    return extra.uncertain(scored(spark, sf))


@query
def x_blend(spark, sf):
    rows = scored(spark, sf).withColumn("other_score", F.round(F.col("score") * F.col("score"), 6))
    return extra.blended(rows, ["score", "other_score"], [3.0, 1.0]).select("source1_entity_id", "other_id", F.round("score", 9).alias("score"))


@query
def x_abbreviations(spark, sf):
    raw = fixtures.relation(spark, sf, "fx_source1").select(F.col("entity_id").alias("source1_entity_id"), text.clean(F.col("business_name")).alias("name_a"))
    other = blocking.tagged(*fixtures.sources(spark, sf)[1:]).select(F.col("entity_id").alias("other_id"), text.clean(F.col("business_name")).alias("name_b"))
    return extra.mined_abbreviations(truth(spark, sf).join(raw, "source1_entity_id").join(other, "other_id"))


@query
def x_french_address(spark, sf):
    return everyone(spark, sf).select("entity_id", extra.french_address(F.concat(F.lit("12 r du ch de q "), text.clean(F.col("business_address")))).alias("value"))


@query
def x_french_region(spark, sf):
    digits = F.concat(F.lit("000"), F.regexp_replace("entity_id", "[^0-9]", ""))
    return everyone(spark, sf).select("source", "entity_id", extra.french_region(F.concat(F.right(digits, F.lit(3)), F.lit("10"))).alias("value"))


@query
def x_transliterated(spark, sf):
    return everyone(spark, sf).select("entity_id", extra.transliterated(F.concat(F.lit("улица щукова юлия ъ οδος θεοψ "), text.clean(F.col("business_address")))).alias("value"))


# ---- models (no SQL equivalent)


def _labelled(spark, sf) -> DataFrame:
    s1, s2, s3 = fixtures.sources(spark, sf)
    rated = features.compute_features(candidates(spark, sf), features.record_lookup(s1), features.record_lookup(s2.unionByName(s3)), fields=True)
    return materialize(labels.split(labels.label(rated, truth(spark, sf))), "labelled")  # models read it once per tree level


@query
def g_gbt_scores(spark, sf):
    rows = _labelled(spark, sf)
    return model.score(model.fit(rows.where(~F.col("held_out")), rounds=5), rows).select("source1_entity_id", "other_id", "score", "label", "held_out")


@query
def g_out_of_fold(spark, sf):
    return model.out_of_fold(_labelled(spark, sf), folds=2, rounds=3).select("source1_entity_id", "other_id", "oof_score", "label")


@query
def g_calibrated(spark, sf):
    rows = materialize(labels.split(labels.label(scored(spark, sf), truth(spark, sf))), "labelled")
    return model.calibrated(rows, rows.where(~F.col("held_out"))).select("source1_entity_id", "other_id", F.round("score", 9).alias("score"), "label", "held_out")


@query
def g_neural_scores(spark, sf):
    rows = _labelled(spark, sf)
    matcher, _ = neural.fit(rows.where(~F.col("held_out")), max_pairs=5000, epochs=2)
    return neural.score(matcher, rows).select("source1_entity_id", "other_id", "score", "label", "held_out")


@query
def g_policy_matches(spark, sf):
    rows, true = scored(spark, sf), truth(spark, sf)
    fitted = policy.train(policy.episodes(rows, true, max_entities=500), epochs=3)
    return decide.policy_greedy(rows, fitted).select("source1_entity_id", "other_id", "score")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of every source-1 record in each source."""
    rank = Window.partitionBy("source1_entity_id", "source").orderBy(F.desc("name_cosine_sim"), "other_id")
    return candidates(spark, sf).withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")
