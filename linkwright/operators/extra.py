"""Further blocking passes, features and decisions around the core pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import blocking

# Words of French addresses, short to long.
FRENCH_WORDS = {"r": "rue", "ch": "chemin", "q": "quai"}
#: Records of a block of queries and of references in the TF-IDF pass, and grams that are multiplied at a time.
LEFT_BLOCK, RIGHT_BLOCK, GRAM_SLICE = 1024, 2048, 1024
#: Vectors of a block in the nearest-vector passes.
VECTOR_BLOCK = 2048
# The four vector passes (vector column, neighbours, whether only references without an address are asked).
VECTOR_PASSES = {"name_address": ("both", 10, False), "name": ("name", 5, False), "name_only": ("name", 5, True), "address": ("addr", 3, False)}
# Regions of France and the departments (first two digits of a postcode, three overseas) in them.
FRENCH_REGIONS = {
    "auvergne rhone alpes": "01 03 07 15 26 38 42 43 63 69 73 74",
    "bourgogne franche comte": "21 25 39 58 70 71 89 90",
    "bretagne": "22 29 35 56",
    "centre val de loire": "18 28 36 37 41 45",
    "corse": "20",
    "grand est": "08 10 51 52 54 55 57 67 68 88",
    "hauts de france": "02 59 60 62 80",
    "ile de france": "75 77 78 91 92 93 94 95",
    "normandie": "14 27 50 61 76",
    "nouvelle aquitaine": "16 17 19 23 24 33 40 47 64 79 86 87",
    "occitanie": "09 11 12 30 31 32 34 46 48 65 66 81 82",
    "pays de la loire": "44 49 53 72 85",
    "provence alpes cote d azur": "04 05 06 13 83 84",
    "guadeloupe": "971",
    "martinique": "972",
    "guyane": "973",
    "la reunion": "974",
    "mayotte": "976",
}
# Cyrillic and Greek small letters and their Latin forms.
LATIN_FORMS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}


def char_grams(name: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of low to high characters."""
    one = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(one(n) for n in range(low, high + 1)))


def _n_blocks(records: DataFrame, size: int, by: str = "area") -> DataFrame:
    """area (or another column) and n, the blocks of about size records that it is dealt into."""
    return records.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))


def _blocks(unit: DataFrame, counts: DataFrame, side: str, other: str, other_counts: DataFrame) -> DataFrame:
    """area, `side` and `other` (numbers of blocks) and the block's rows (source, entity_id, grams with weights).

    Every block is there once for each block of the other side, so that an
    area's pairs of blocks spread over tasks.
    """
    one = unit.groupBy("area", "source", "entity_id").agg(F.collect_list(F.struct("gram", "w")).alias("grams"))
    one = one.join(counts, "area").withColumn(side, F.pmod(F.xxhash64("source", "entity_id"), F.col("n")).cast("int"))
    block = one.groupBy("area", side).agg(F.collect_list(F.struct("source", "entity_id", "grams")).alias(f"{side}_rows"))
    return block.join(other_counts, "area").withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def _dots(left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
    """Dot products of the gram weights of all rows of one block with all of another."""
    sides, words = [], []
    for rows in (left, right):
        held = rows.field("grams")
        flat = held.flatten()
        words.append(flat.field("gram"))
        sides.append((len(rows), np.repeat(np.arange(len(rows)), pc.list_value_length(held).to_numpy()), flat.field("w").to_numpy()))
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
    codes = codes[: len(words[0])], codes[len(words[0]) :]
    common = np.intersect1d(*codes)
    out = np.zeros((len(left), len(right)))
    for a in range(0, len(common), GRAM_SLICE):
        some, dense = common[a : a + GRAM_SLICE], []
        for (n, row, w), code in zip(sides, codes, strict=True):
            at = np.minimum(np.searchsorted(some, code), len(some) - 1)
            has = some[at] == code
            table = np.zeros((n, len(some)))
            table[row[has], at[has]] = w[has]
            dense.append(table)
        out += dense[0] @ dense[1].T
    return out


def tfidf_neighbours(source1: DataFrame, reference: DataFrame, k: int = 15, floor: float = 0.2) -> DataFrame:
    """The k most similar reference names per record and source within an area, by TF-IDF cosine of 2- to 4-grams (X-1).

    source1 and reference are prepared records. All grams count, however
    frequent. Nearly all names of an area share some gram, so an inverted index
    would emit a row for each pair and gram; instead blocks of records meet
    pairwise, each pair of blocks as products of matrices, and only what may be
    among a block's k best comes out.
    """
    rows = source1.select(F.lit("S1").alias("source"), "entity_id", "area", "name").unionByName(reference.select("source", "entity_id", "area", "name"))
    grams = rows.select("source", "entity_id", "area", F.explode(char_grams(F.col("name"))).alias("gram"))
    tf = grams.groupBy("source", "entity_id", "area", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.where("source <> 'S1'").groupBy("area", "gram").agg(F.count(F.lit(1)).alias("df"))
    total = reference.groupBy("area").agg(F.count(F.lit(1)).alias("total"))
    weights = tf.join(df, ["area", "gram"], "left").join(total, "area", "left").fillna(0, subset=["df", "total"])
    weights = weights.withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norms = weights.groupBy("source", "entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weights.join(norms, ["source", "entity_id"]).withColumn("w", F.col("w") / F.col("norm")).where(F.col("df") > 0)
    lefts, rights = _n_blocks(source1, LEFT_BLOCK), _n_blocks(reference, RIGHT_BLOCK)
    left = _blocks(unit.where("source = 'S1'"), lefts, "left", "right", rights)
    right = _blocks(unit.where("source <> 'S1'"), rights, "right", "left", lefts)
    met = left.join(right, ["area", "left", "right"]).select("left_rows", "right_rows")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ones, others = (batch.column(c)[i].values for c in range(2))
                dots, source = _dots(ones, others), others.field("source").to_numpy(zero_copy_only=False)
                for name in np.unique(source):
                    at = np.flatnonzero(source == name)
                    part = dots[:, at]
                    # ties after rounding to 6 digits are settled by id later, so all of them come out
                    least = np.partition(part, -k, axis=1)[:, -k] - 2e-6 if len(at) > k else np.full(len(part), -np.inf)
                    one, other = np.nonzero(part >= np.maximum(least, floor - 1e-6)[:, None])
                    ids = ones.field("entity_id").take(pa.array(one)), others.field("entity_id").take(pa.array(at[other]))
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([name] * len(one), pa.string()), pa.array(part[one, other])], ["source1_entity_id", "other_id", "source", "similarity"])

    found = met.mapInArrow(run, "source1_entity_id string, other_id string, source string, similarity double")
    found = found.withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("source1_entity_id", "source").orderBy(F.desc("similarity"), "other_id"))
    return found.where(F.col("similarity") >= floor).withColumn("rank", rank).where(F.col("rank") <= k)


def rare_token_pairs(source1: DataFrame, reference: DataFrame, min_length: int = 4, max_df: int = 20) -> DataFrame:
    """Pairs of an area that share a name token of min_length characters which max_df reference records have at most (X-2)."""
    words = lambda df, *cols: df.select(*cols, "area", F.explode(text.token_set(F.col("name"))).alias("token")).where(F.length("token") >= min_length)
    right = words(reference, F.col("entity_id").alias("other_id"), "source")
    rare = right.groupBy("area", "token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= max_df).select("area", "token")
    right = right.join(rare, ["area", "token"])
    left = words(source1, F.col("entity_id").alias("source1_entity_id"))
    return left.join(right, ["area", "token"]).groupBy("source1_entity_id", "other_id", "source").agg(F.count(F.lit(1)).alias("shared"))


def _directed(rows: DataFrame) -> DataFrame:
    """id, block, vector of the rows whose vector has a direction: not null or empty, all components finite, one not zero."""
    vector = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("id", "block", vector.alias("vector")).where(finite & F.exists("vector", lambda x: x != 0))


def _vector_blocks(rows: DataFrame, side: str, counts: DataFrame, other: str, other_counts: DataFrame) -> DataFrame:
    """block, `side` and `other` (numbers of its parts) and the part's rows, once for each part of the other side."""
    dealt = rows.join(counts, "block").withColumn(side, F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    part = dealt.groupBy("block", side).agg(F.collect_list(F.struct("id", "vector")).alias(f"{side}_rows"))
    return part.join(other_counts, "block").withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def vector_neighbours(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest vectors of the same block, by cosine (X-3). left, right: id, block, vector. Exact within a block.

    A block's vectors are dealt into parts of bounded size that meet pairwise as
    products of matrices; only what may be among a part's k best comes out. A
    vector that is null, empty, zero or not finite, or in no block, has no
    neighbours; those of a block have one length. Ties go to the smaller id.
    """
    left, right = _directed(left), _directed(right)
    lefts, rights = _n_blocks(left, VECTOR_BLOCK, "block"), _n_blocks(right, VECTOR_BLOCK, "block")
    met = _vector_blocks(left, "left", lefts, "right", rights).join(_vector_blocks(right, "right", rights, "left", lefts), ["block", "left", "right"])

    def units(rows: pa.StructArray) -> np.ndarray:
        table = rows.field("vector").flatten().to_numpy().reshape(len(rows), -1)
        table = table / np.abs(table).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
        return table / np.linalg.norm(table, axis=1, keepdims=True)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ones, others = (batch.column(c)[i].values for c in (1, 2))
                dots = units(ones) @ units(others).T
                one_ids, other_ids = ones.field("id"), others.field("id")
                dots[one_ids.to_numpy(zero_copy_only=False)[:, None] == other_ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                # ties after rounding to 6 digits are settled by id later, so all of them come out
                least = np.partition(dots, -k, axis=1)[:, -k] - 2e-6 if len(others) > k else np.full(len(ones), -2.0)
                one, other = np.nonzero(dots >= np.maximum(least, -2.0)[:, None])
                block = pa.array([batch.column(0)[i].as_py()] * len(one), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([one_ids.take(pa.array(one)), other_ids.take(pa.array(other)), block, pa.array(dots[one, other])], ["left_id", "right_id", "block", "similarity"])

    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    near = met.select("block", "left_rows", "right_rows").mapInArrow(run, f"left_id {kind['id']}, right_id {kind['id']}, block {kind['block']}, similarity double")
    near = near.withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_passes(left: DataFrame, right: DataFrame, passes: dict[str, tuple[str, int, bool]] = VECTOR_PASSES) -> DataFrame:
    """The nearest references of each record in every pass (X-3): pass, left_id, right_id, block, similarity, rank.

    left, right: id, block and the vectors both, name and addr, the last null
    where a record has no address. A pair may come out of several passes.
    """
    out = None
    for name, (column, k, addressless) in passes.items():
        side = lambda df: df.select("id", "block", F.col(column).alias("vector"))  # noqa: B023, E731
        found = vector_neighbours(side(left), side(right.where("addr is null") if addressless else right), k).withColumn("pass", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def name_key_pairs(source1: DataFrame, reference: DataFrame, cap: int = 50) -> DataFrame:
    """Pairs that share a canonical (type 0) or a phonetic (type 1) name key which at most cap records of a source have (X-5).

    source1 and reference are prepared; larger buckets are left out per source
    and key type, as in the core blocking. source1_entity_id, other_id, source, key_type.
    """
    name = F.col("name")
    canonical = F.array_join(F.array_sort(text.tokens(name)), " ")
    sounds = F.array_join(F.transform(F.slice(text.tokens(name), 1, 2), text.sound_key), " ")
    keyed = lambda df: df.withColumn("keys", F.array(*(F.concat_ws("|", "area", k) for k in (canonical, sounds))))
    return blocking.shared_keys(keyed(source1), keyed(reference), cap)


def pair_details(pairs: DataFrame) -> DataFrame:
    """Further features of pairs with both records' fields (X-8).

    house_match, post_match: 1 equal, 0 different, 0.5 where a record has none.
    aligned_share: places where both names have the same token, of the longer
    name's. first_token_match. plain_name_match: equal names but for the order
    of tokens, blanks and vowels. same_house: pairs of the entity with house_match 1.
    """
    name_a, name_b, addr_a, addr_b = (F.col(c) for c in ("name_a", "name_b", "addr_a", "addr_b"))
    match = lambda f: F.when((f(addr_a) == "") | (f(addr_b) == ""), 0.5).otherwise((f(addr_a) == f(addr_b)).cast("double"))
    ones, others = text.tokens(name_a), text.tokens(name_b)
    aligned = F.size(F.filter(F.zip_with(ones, others, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same))
    longer = F.greatest(F.size(ones), F.size(others))
    plain = lambda c: F.regexp_replace(F.array_join(F.array_sort(text.tokens(c)), " "), "[aeiou ]", "")
    both = lambda f: ((f(name_a) != "") & (f(name_a) == f(name_b))).cast("double")
    out = pairs.withColumns({
        "house_match": match(text.house_number),
        "post_match": match(text.postcode),
        "aligned_share": F.when(longer == 0, 0.0).otherwise(aligned / longer),
        "first_token_match": both(text.first_token),
        "plain_name_match": both(plain),
    })
    return out.withColumn("same_house", F.count_if(F.col("house_match") == 1).over(Window.partitionBy("source1_entity_id")))


def extra_keys(prepared: DataFrame) -> DataFrame:
    """Further exact keys appended to `keys` (X-4, X-5): whole name, sorted name tokens, whole address, name and
    postcode, house and postcode, sorted name tokens without vowels, phonetic keys of the first two tokens."""
    area, name, addr = F.col("area"), F.col("name"), F.col("addr")
    tokens = F.array_join(F.array_sort(text.tokens(name)), " ")
    sounds = F.array_join(F.transform(F.slice(text.tokens(name), 1, 2), text.sound_key), " ")
    both = lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)).otherwise(F.lit(""))
    more = (name, tokens, addr, both(name, F.col("post")), both(F.col("house"), F.col("post")), F.regexp_replace(tokens, "[aeiou ]", ""), sounds)
    return prepared.withColumn("keys", F.concat("keys", F.array(*(F.concat_ws("|", area, k) for k in more))))


def competition(scored: DataFrame) -> DataFrame:
    """How a pair stands among those of either record (X-8): rank, gap to the best and number, on both sides."""
    out = scored
    for side, other in (("source1_entity_id", "other_id"), ("other_id", "source1_entity_id")):
        tag = "s1" if side.startswith("source1") else "other"
        line, whole = Window.partitionBy(side).orderBy(F.desc("score"), other), Window.partitionBy(side)
        out = out.withColumns({f"{tag}_rank": F.row_number().over(line), f"{tag}_gap": F.round(F.max("score").over(whole) - F.col("score"), 6), f"{tag}_count": F.count(F.lit(1)).over(whole)})
    return out


def agreement(scored: DataFrame) -> DataFrame:
    """The best score of the entity's candidates in its other source, and of its siblings in the same one (X-10)."""
    whole = Window.partitionBy("source1_entity_id")
    best = lambda s: F.max(F.when(F.col("source") == s, F.col("score"))).over(whole)
    line = Window.partitionBy("source1_entity_id", "source").orderBy(F.desc("score"), "other_id")
    second = F.max(F.when(F.col("_at") == 2, F.col("score"))).over(Window.partitionBy("source1_entity_id", "source"))
    out = scored.withColumn("cross_best", F.coalesce(F.when(F.col("source") == "S2", best("S3")).otherwise(best("S2")), F.lit(0.0)))
    out = out.withColumn("_at", F.row_number().over(line))
    top = F.max(F.when(F.col("_at") == 1, F.col("score"))).over(Window.partitionBy("source1_entity_id", "source"))
    return out.withColumn("sibling_best", F.coalesce(F.when(F.col("_at") == 1, second).otherwise(top), F.lit(0.0))).drop("_at")


def pruned(scored: DataFrame, k: int = 10, floor: float = 0.01) -> DataFrame:
    """The k best candidates of a cheap model with a score of at least floor (X-6)."""
    rank = F.row_number().over(Window.partitionBy("source1_entity_id").orderBy(F.desc("score"), "other_id"))
    return scored.where(F.col("score") >= floor).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def uncertain(scored: DataFrame, low: float = 0.05, high: float = 0.9) -> DataFrame:
    """Pairs that a costlier model should look at (X-9): low <= score < high."""
    return scored.where((F.col("score") >= low) & (F.col("score") < high))


def blended(scored: DataFrame, columns: list[str], weights: list[float] | None = None) -> DataFrame:
    """`score` as the weighted mean of several models' columns (X-15)."""
    weights = weights or [1.0] * len(columns)
    total = sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return scored.withColumn("score", total / sum(weights))


def french_address(address: Column) -> Column:
    """Short words of a French address written out (X-7)."""
    pairs = F.create_map(*(F.lit(x) for p in FRENCH_WORDS.items() for x in p))
    return F.array_join(F.transform(text.tokens(address), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), " ")


def french_region(post: Column) -> Column:
    """The region of a French postcode of five digits (X-7); '' where there is none."""
    pairs = F.create_map(*(F.lit(x) for region, departments in FRENCH_REGIONS.items() for d in departments.split() for x in (d, region)))
    found = F.coalesce(F.try_element_at(pairs, F.substring(post, 1, 3)), F.try_element_at(pairs, F.substring(post, 1, 2)), F.lit(""))
    return F.when(post.rlike("^[0-9]{5}$"), found).otherwise(F.lit(""))


def transliterated(cleaned: Column) -> Column:
    """Cleaned text with Cyrillic and Greek letters in Latin ones (X-7); others stay."""
    out = cleaned
    for letter, latin in LATIN_FORMS.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = sorted((c for c in LATIN_FORMS.items() if len(c[1]) < 2), key=lambda c: not c[1])  # translate drops letters without a counterpart at the end
    return F.translate(out, "".join(a for a, _ in single), "".join(b for _, b in single))


def mined_abbreviations(pairs: DataFrame, min_count: int = 5) -> DataFrame:
    """short, long, n: tokens that true pairs (name_a, name_b) have at the same place, one a beginning of the other (X-7)."""
    aligned = F.arrays_zip(text.tokens(F.col("name_a")).alias("a"), text.tokens(F.col("name_b")).alias("b"))
    same_size = F.size(text.tokens(F.col("name_a"))) == F.size(text.tokens(F.col("name_b")))
    rows = pairs.where(same_size).select(F.explode(aligned).alias("t")).select(F.col("t.a").alias("a"), F.col("t.b").alias("b")).where("a <> b")
    short, long = F.when(F.length("a") <= F.length("b"), F.col("a")).otherwise(F.col("b")), F.when(F.length("a") <= F.length("b"), F.col("b")).otherwise(F.col("a"))
    rows = rows.select(short.alias("short"), long.alias("long")).where(F.col("long").startswith(F.col("short")))
    return rows.groupBy("short", "long").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def without_ids(rows: DataFrame, ids: DataFrame, by: str = "source1_entity_id") -> DataFrame:
    """The rows of other ids (X-12)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(by)), by, "left_anti")


def better(value: float, best: float, margin: float = 0.002) -> bool:
    """Whether a model is kept: it must gain at least margin on the validation metric (X-18)."""
    return value >= best + margin
