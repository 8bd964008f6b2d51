"""Normalisation and similarity against values worked out by hand and plain Python."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.functions import similarity, text


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "pairs"),
    [
        (text.clean, [(None, ""), (" NaN ", ""), ("None", ""), ("", ""), ("U.S.", "u s"), ("A\t\n B", "a b"), ("a_b", "a_b")]),
        (text.normalize_name, [("McDonald's & Sons Corporation", "mcdonald s & sons corp"), ("Café Brothers Pvt. Ltd.", "cafe bros pvt ltd"), ("", "")]),
        (text.normalize_address, [("12 Saint Mary Street, Near The Old Road", "12 st mary st old rd"), ("A & B Opposite", "a and b"), (None, "")]),
        (text.normalize_country, [("USA", "united states"), ("U.S.A.", "united states"), ("IN", "india"), ("Fr", "france"), ("Brasil", "brasil"), (None, "")]),
        (lambda c: text.house_number(text.clean(c)), [("Flat 12B, 34 High St", "12"), ("High St", ""), ("٣ x", "٣")]),
        (lambda c: text.postcode(text.clean(c)), [("12 Foo 3", "3"), ("12 Foo 110001, 4567", "110001"), ("1234 5678", "1234"), ("Foo", "")]),
        (lambda c: text.digit_key(text.normalize_address(c)), [("1 A 23", "123"), ("12 B 3", "123"), ("x", "")]),
        (text.sound_key, [("tymczak", "t52"), ("pfister", "p236"), ("robert", "r163"), ("ashcraft", "a2613"), ("honeyman", "h5"), ("bubble", "b4"), ("", ""), ("東京", "")]),
        (lambda c: text.name_prefix(c, 4), [("a b cdef", "abcd"), ("", "")]),
        (text.plain_country, [(" USA ", "usa"), (None, "")]),
        (lambda c: F.array_join(text.token_set(c), ","), [("b a  b", "b,a"), ("", "")]),
    ],
)
def test_normalisation(spark, column, pairs):
    assert values(spark, column, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_accents_follow_python(spark):
    """Every character there is, alone and among others."""
    words = ["Ångström", "naïve façade", "हिन्दी", "été", "ＡＢＣ", "Ǆ plain", "½", "ﬁn", "한국", "", None, "\ufdfa x"]
    words += ["".join(chr(c) for c in range(a, a + 64)) for a in range(0x80, 0x110000, 64) if not 0xD800 <= a < 0xE000]
    plain = [None if w is None else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in words]
    assert values(spark, text.strip_accents, words) == plain


def test_white_space_is_trimmed_as_python_does(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    words = [f"{b}None{b}" for b in blanks] + [f"{b}USA{b}" for b in blanks]
    assert values(spark, text.clean, words) == [""] * len(blanks) + ["usa"] * len(blanks)
    assert values(spark, text.plain_country, words) == [w.strip().lower() for w in words]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for x, y in [(a, b)] + ([(b, a)] if len(a) == len(b) else []):
        for i in range(1 - len(x), len(y)):
            w = y[max(i, 0) : i + len(x)]
            best = max(best, 200 * lcs(x, w) / (len(x) + len(w)))
    return best


short = st.text("abcé ", max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(short, short), min_size=1, max_size=12))
def test_kernels_follow_a_plain_version(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert similarity.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in pairs]
    assert similarity.lcs_lengths(b, a).tolist() == similarity.lcs_lengths(a, b).tolist()
    assert similarity.partial_ratios(a, b).tolist() == pytest.approx([partial(x, y) for x, y in pairs])
    assert all(0 <= r <= 100 for r in similarity.indel_ratios(a, b))


def test_kernels_at_and_beyond_a_word():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    a, b = [make(n) for n in (63, 64, 64, 65, 130, 200)], [make(n) for n in (64, 64, 90, 65, 70, 10)]
    assert similarity.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.partial_ratios(a, b).tolist() == pytest.approx([partial(x, y) for x, y in zip(a, b, strict=True)])


def test_ratios(spark):
    rows = [("acme corp", "acme co", 87.5), ("abc", "xbz", 100 / 3), ("b a", "a b", 100.0), ("", "x", 0.0), ("", "", 100.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    a, b = F.col("a"), F.col("b")
    found = df.select("want", similarity.token_sort_ratio(a, b).alias("udf"), similarity.native_indel_ratio(similarity.sorted_tokens(a), similarity.sorted_tokens(b)).alias("native"), similarity.indel_bound(a, b).alias("bound")).collect()
    for r in found:
        assert r["udf"] == pytest.approx(r["want"])
        assert r["native"] == pytest.approx(r["want"])
        assert r["bound"] >= r["want"] - 1e-9


def test_sets_and_lengths(spark):
    df = spark.createDataFrame([("", ""), ("", "a"), ("a b", "b c"), ("a a b", "b a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(similarity.token_jaccard(a, b)).collect()] == [1.0, 0.0, pytest.approx(1 / 3), 1.0]
    assert [r[0] for r in df.select(similarity.length_difference(a, b)).collect()] == [0.0, 1.0, 0.0, 2.0]
    assert [r[0] for r in df.select(similarity.country_match(a, b)).collect()] == [0.0] * 4


def test_long_strings_take_several_words():
    """Shorter strings of 64, 65, 128 and more characters: carries pass from word to word."""
    rng = random.Random(7)
    word = lambda n, letters="abcd": "".join(rng.choice(letters) for _ in range(n))
    sizes = (1, 5, 63, 64, 65, 70, 128, 129, 150)
    a, b = ([word(rng.choice(sizes)) for _ in range(60)] for _ in range(2))
    a += ["a" * 130, "ab" * 70, "x" * 200]
    b += ["a" * 129 + "b", "ba" * 70, "y" * 150]
    assert similarity.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    some = slice(45, 63)
    assert similarity.partial_ratios(a[some], b[some]) == pytest.approx([partial(x, y) for x, y in zip(a[some], b[some], strict=True)])
