"""Pairwise features of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text

# The columns of the feature table.
FEATURES = (
    "name_cosine_sim",
    "name_token_sort_ratio",
    "name_partial_ratio",
    "name_jaccard",
    "name_len_diff",
    "addr_token_sort_ratio",
    "addr_partial_ratio",
    "addr_jaccard",
    "addr_len_diff",
    "country_match",
)
#: A record's fields that features compare.
FIELDS = ("name", "addr", "country")


def record_lookup(records: DataFrame) -> DataFrame:
    """entity_id with normalised name and address and the plain country; one row per id (J-2)."""
    rows = records.select("entity_id", text.normalize_name(F.col("business_name")).alias("name"), text.normalize_address(F.col("business_address")).alias("addr"), text.plain_country(F.col("country")).alias("country"))
    return rows.dropDuplicates(["entity_id"])


def prepared_lookup(records: DataFrame) -> DataFrame:
    """The same from prepared records, which are not normalised again."""
    return records.select("entity_id", "name", "addr", text.plain_country(F.col("country")).alias("country")).dropDuplicates(["entity_id"])


def with_fields(candidates: DataFrame, source1: DataFrame, others: DataFrame, parts: bool = False) -> DataFrame:
    """Candidates with both records' fields (J-1); ids that a lookup lacks get empty fields.

    With `parts`, also sorted names and addresses and their distinct tokens, as
    name_sorted_a, addr_tokens_b and so on, made once per record.
    """
    made = {f"{c}_{p}": f(F.col(c)) for c in FIELDS[:2] for p, f in (("sorted", similarity.sorted_tokens), ("tokens", text.token_set)) if parts}
    empty = {c: F.array().cast("array<string>") if c.endswith("_tokens") else F.lit("") for c in (*FIELDS, *made)}

    def side(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{c}_{tag}") for c in FIELDS), *(x.alias(f"{c}_{tag}") for c, x in made.items()))

    both = candidates.join(side(source1, "source1_entity_id", "a"), "source1_entity_id", "left").join(side(others, "other_id", "b"), "other_id", "left")
    return both.withColumns({f"{c}_{t}": F.coalesce(f"{c}_{t}", e) for c, e in empty.items() for t in "ab"})


def compute_features(candidates: DataFrame, source1: DataFrame, others: DataFrame, fields: bool = False) -> DataFrame:
    """The candidates with the columns FEATURES, and with both records' fields if asked for.

    source1 and others are lookups. All six kernels run in one pass over Arrow
    batches; the rest is generated code. name_cosine_sim is taken over, or made
    from the names where candidates lack it.
    """
    extra = [c for c in candidates.columns if c not in FEATURES]
    f = F.col
    rated = with_fields(candidates, source1, others, parts=True)
    rated = rated.withColumns({f"{c}_token_sort_ratio": similarity.indel_ratio(f"{c}_sorted_a", f"{c}_sorted_b") / 100 for c in ("name", "addr")})
    rated = rated.withColumn("name_partial_ratio", similarity.partial_ratio("name_a", "name_b") / 100).withColumn("addr_partial_ratio", similarity.partial_ratio("addr_a", "addr_b") / 100)
    rated = rated.withColumns({
        "name_jaccard": similarity.pair_jaccard("name_sorted_a", "name_sorted_b"),
        "name_len_diff": similarity.length_difference(f("name_a"), f("name_b")),
        "addr_jaccard": similarity.pair_jaccard("addr_sorted_a", "addr_sorted_b"),
        "addr_len_diff": similarity.length_difference(f("addr_a"), f("addr_b")),
        "country_match": similarity.country_match(f("country_a"), f("country_b")),
    })
    if "name_cosine_sim" not in candidates.columns:
        rated = rated.withColumn("name_cosine_sim", f("name_token_sort_ratio"))
    return rated.select(*extra, *FEATURES, *(f"{c}_{t}" for c in FIELDS for t in "ab" if fields))


def formula_score(features: DataFrame) -> DataFrame:
    """A score without a model: the mean of four ratios, rounded, as `score`."""
    parts = ("name_token_sort_ratio", "name_jaccard", "addr_token_sort_ratio", "addr_jaccard")
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return features.withColumn("score", F.round(total / len(parts), 6))
