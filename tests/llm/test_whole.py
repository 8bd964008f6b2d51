"""Training-data operators do the whole job: nothing is left out because it is short, long, rare or odd."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import bagminhash, chat, chunking, langid, mixing, near_vectors, packing, quality, queries, sharding, warc
from linkwright.llm.common import numbered, table


def test_symbols_beyond_ascii_are_symbols(spark):
    """Junk of signs that are no ASCII is far from its language; 120 words are enough to be judged by words."""
    rng = random.Random(4)
    common = "the of and to in is that it was for on are as with his they at be this from".split()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    plain = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n))
    signs = lambda n: " ".join("".join(rng.choice("•●■□▪►★☆✓✔═║╬░▒▓😀😂🎉�€™") for _ in range(5)) for _ in range(n))
    given = [(i, plain(300)) for i in range(100)] + [(100, signs(100)), (101, " ".join(word() for _ in range(130))), (102, plain(130))]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert not found[100]["base_failed"] and not found[100]["kept"]
    assert found[101]["word_distance"] is not None and not found[101]["base_failed"] and not found[101]["kept"]
    assert found[102]["word_distance"] is not None and found[102]["kept"]


def test_every_window_of_fifty_words(spark):
    """Passages of short words, of numbers and of few words, and one whose chunks an earlier document has without it."""
    rng = random.Random(6)
    kinds = [lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"), lambda: str(rng.randint(0, 99)), lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))), lambda: rng.choice(["no", "yes"])]
    own = lambda n: ["".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    given, want = {}, {}
    for t in range(80):
        passage = [kinds[t % 4]() for _ in range(50)]
        for k in range(2):
            given[2 * t + k], want[2 * t + k] = own(60) + passage + own(60), 50 * k
    for t in range(40):
        passage, i = own(50), 1000 + 3 * t
        given[i], given[i + 1], given[i + 2] = passage[5:45] + own(40), own(40) + passage + own(40), own(70) + passage + own(40)
        want |= {i: 0, i + 1: 0, i + 2: 50}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in given.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["removed_words"] for r in chunking.dedup_passages(df).collect()} == want


def test_header_of_any_length(spark):
    """A page with a url of 100 KB comes back, and so does the revisit that refers to it."""
    given = [(1, "http://x/" + "a" * 100_000, "long"), (2, "http://x/", "long"), (3, "http://y/" + " é" * 50_000, "other")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert found == {1: ("response", 4, None), 2: ("revisit", 4, 1), 3: ("response", 5, None)}


def test_header_ends_before_the_next_version_line():
    """A header that is cut off does not swallow the record behind it."""
    body = b"x" * 100
    good = warc.record(2, "u", body, hashlib.sha1(body).digest(), len(body), None, False)
    found = list(warc.salvage(b"WARC/1.1\r\nWARC-Type: response\r\n" + good))
    assert [x.reason for x in found] == ["header without end", ""] and found[1].block.endswith(body)


# ---- texts of any kind and size


def test_long_white_space_is_tokenised(spark):
    """Runs of white space that exceed the fast library's stack have the vocabulary file's ids, one by one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * n for n in (1_000_000, 5_000_000) for c in " \n\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = {}
    for r in packing.pack_documents(df).collect():
        found.setdefault(r["doc_id"], {})[r["start"]] = r["length"], r["ids_crc32"]
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert found[i] == {a: (n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in packing.cut(len(ids), 2048)}


def test_copy_with_a_monotonous_middle(spark):
    """An exact copy loses every word, however long its chunks are."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for n in (4_000, 800_000):
        text = f"{prose(100)} {'ab cd ' * (n // 2)}{prose(100)}"
        other = f"{prose(60)} {'ab cd ' * (n // 2)}{prose(60)}"
        df = spark.createDataFrame([(1, text), (2, text), (3, other)], "doc_id long, text string")
        found = {r["doc_id"]: r for r in chunking.dedup_passages(df).collect()}
        assert found[1]["removed_words"] == 0
        assert found[2]["removed_words"] == n + 200 and found[2]["text"] == ""
        assert found[3]["removed_words"] == n and len(found[3]["text"].split()) == 120


def test_one_id_with_two_texts(spark):
    """The text with the smallest hash is the document, whatever the order of rows; near copies of either text link."""
    rng = random.Random(9)
    prose = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    a, b, passage = prose(120), prose(120), prose(80)
    near = lambda w: [*w[:60], "changed", *w[61:]]
    given = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, prose(100)), (1, passage), (6, prose(40) + passage + prose(40)), (6, prose(100)), (None, a)]
    rows = [(i, " ".join(w)) for i, w in given]
    seen = set()
    for order in range(4):
        random.Random(order).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(order + 1)
        classes = {(r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(df).collect()}
        assert classes == {(i, 5) for i in (5, 7, 8)} | {(i, i) for i in (9, 1, 6)} | {(None, None)}
        out = chunking.dedup_passages(df).collect()
        assert len(out) == len(rows)
        for r in out:
            whole = [t for i, t in rows if i == r["doc_id"]]
            if r["removed_words"]:
                assert len(r["text"].split()) + r["removed_words"] in {len(t.split()) for t in whole}
            else:
                assert r["text"] in whole
        seen.add(frozenset((r["doc_id"], r["removed_words"], r["text"]) for r in out))
    assert len(seen) == 1


# ---- vectors


def brute_links(x, threshold=0.95):
    u = near_vectors.unit(x)
    like = u @ u.T >= threshold
    np.fill_diagonal(like, False)
    return like & (np.abs(u).sum(axis=1) > 0)[:, None]


def test_recall_on_the_table(spark, sf):
    rows = [r for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect() if r[1] is not None]
    want = brute_links(np.array([r[1] for r in rows], np.float64)).sum(axis=1)
    found = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(table(spark, sf, "embeddings")).collect()}
    got = np.array([found[r[0]] for r in rows])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_vectors_that_point_much_the_same_way(spark):
    """Mean cosine of about 0.8: pivots fill up, and links are found."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 24)) + 2 * np.sqrt(24) * np.eye(24)[0] * 1.0
    x = base[rng.integers(0, 500, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    u = near_vectors.unit(x)
    assert 0.7 < (u[:200] @ u[200:400].T).mean() < 0.85
    assert len(near_vectors.choose_pivots(u, near_vectors.n_pivots(2000))) == near_vectors.n_pivots(2000)
    want = brute_links(x).sum()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert want > 1000 and 0.9 * want <= near_vectors.near_vectors(df).agg(F.sum("n_links")).first()[0] <= want


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    told = set()
    for order in range(4):
        random.Random(order).shuffle(rows)
        found = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(order + 1)).collect()
        assert len(found) == 4 and max(r["n_links"] for r in found) == 1
        told.add(frozenset(tuple(r) for r in found))
    assert len(told) == 1 and len(next(iter(told))) == 3  # both rows of 1 say the same


# ---- WARC


def noise(i, version=b"WARC/1.1"):
    body = np.random.default_rng(i).integers(0, 256, 3000).astype(np.uint8).tobytes()
    return warc.record(i, f"u{i}", body, hashlib.sha1(body).digest(), len(body), None, False).replace(b"WARC/1.1", version, 1)


def salvaged(data):
    found = list(warc.salvage(data))
    return [int(re.search(r"\d+", x.fields["warc-record-id"])[0]) for x in found if x.fields], [x for x in found if not x.fields]


def test_salvage_inside_members():
    records = [noise(i) for i in range(10)]
    hurt = bytearray(b"".join(records))
    hurt[4 * len(records[0]) + 1000] ^= 0xFF
    rest = [i for i in range(10) if i != 4]
    one = gzip.compress(bytes(hurt))
    ids, gaps = salvaged(one)  # the record was damaged before it was packed
    assert ids == rest and len(gaps) == 1 and "block digest" in gaps[0].reason
    whole = gzip.compress(b"".join(records))
    ids, gaps = salvaged(whole[:-20])
    assert ids == list(range(9)) and [(g.start, g.end) for g in gaps] == [(0, len(whole) - 20)]
    ids, gaps = salvaged(whole[: len(whole) // 2] + whole[len(whole) // 2 + 1 :])
    assert ids[:4] == [0, 1, 2, 3] and gaps
    ids, gaps = salvaged(gzip.compress(records[0]) + whole[:-20] + gzip.compress(noise(10)))
    assert ids == [0, *range(9), 10] and len(gaps) == 1


def test_any_version_line_is_found():
    for version in (b"WARC/0.18", b"WARC/2.0"):
        records = [noise(i, version) for i in range(10)]
        hurt = bytearray(b"".join(records))
        hurt[2 * len(records[0]) + 500] ^= 0xFF
        ids, gaps = salvaged(bytes(hurt))
        assert ids == [0, 1, 3, 4, 5, 6, 7, 8, 9] and len(gaps) == 1


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(1)
    pages = [(i, "u", "".join(chr(rng.randrange(33, 120)) for _ in range(50_000 if i == 7 else 3000))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 5 and sizes[-2] <= 20_000 + len(warc.EMPTY_MEMBER) < sizes[-1]
    assert {r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == set(range(60))


def test_lost_pages_are_told(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    write = warc.write_archives

    def hurt(pages, path, *more):
        write(pages.coalesce(1), path, *more)
        folder = path.removeprefix("file:")
        f = next(Path(folder).glob("part-*"))
        data = bytearray(f.read_bytes())
        data[len(data) // 2] ^= 0xFF
        f.write_bytes(bytes(data))
        for crc in Path(folder).glob(".*.crc"):
            crc.unlink()

    monkeypatch.setattr(warc, "write_archives", hurt)
    with pytest.raises(warc.Incomplete, match="19 of 20"):
        warc.round_trip(pages, str(tmp_path / "q"))
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "q")).collect()]


# ---- many languages


def tongues(n, seed=1):
    """n invented languages: each has syllables and common words of its own."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") + rng.choice("aeiouäöüéèåø") for _ in range(1)) for _ in range(14)]
        out.append(["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)])
    return out


def test_three_hundred_languages_are_learned(spark):
    rng = random.Random(2)
    vocabulary = tongues(300)
    rows = [(300 * k + i, " ".join(rng.choice(w) for _ in range(120)), f"l{i:03}") for i, w in enumerate(vocabulary) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300 and len(np.unique(model.code, axis=0)) == 300
    found = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_three_hundred_languages_have_references(spark):
    rng = random.Random(3)
    vocabulary = tongues(300)
    say = lambda w: " ".join(w[min(int(rng.expovariate(0.08)), 59)] for _ in range(400))
    rows = [(300 * k + i, say(w), f"l{i:03}") for i, w in enumerate(vocabulary) for k in range(6)]
    rows += [(10_000 + i, say(vocabulary[(i + 7) % 300]), f"l{i:03}") for i in range(300)]
    found = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    judged = [i for i in found if not found[i]["base_failed"]]
    assert np.mean([found[i]["kept"] for i in judged if i < 10_000]) > 0.95
    assert np.mean([found[i]["kept"] for i in judged if i >= 10_000]) < 0.05


@pytest.mark.parametrize("bits", [4, 24, 61])
def test_repeated_windows_are_exact(spark, monkeypatch, bits):
    """Numbers that do not fit a sort key (4 bits), and hashes of which a key holds 3 bits (61)."""
    monkeypatch.setattr(quality, "POSITION", bits)
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 18, 30, 80, 200) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judged(docs, keep=("doc_id", "text")).collect():
        w = r["text"].split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        assert r["n_repeat_words"] == len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)})


# ---- mixing


def pareto(rng, p, n):
    """Which of the items a plain Pareto sample of n takes."""
    u = rng.random(len(p))
    out = np.zeros(len(p), bool)
    out[np.argsort((u / (1 - u)) / (p / (1 - p)))[:n]] = True
    return out


def test_inclusion_follows_a_plain_pareto_sampler(spark):
    """Weights of 1, 2 and 8, equal sizes: shares taken by weight are a plain sampler's, and those of the odds."""
    weights = np.array([1.0, 2.0, 8.0] * 400)
    rows = [(i, "w " * 5, "a", float(w)) for i, w in enumerate(weights)] + [(10_000 + i, "w " * 5, "b", 1.0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, importance double")
    theta = 2.0 ** np.linspace(-10, 10, 200_001)
    expected = sum((theta * w / (1 + theta * w)) for w in (1, 2, 8)) * 400
    theta = theta[np.argmin(np.abs(expected - 800))]  # source a gets two thirds of its words
    p = theta * weights / (1 + theta * weights)
    rng, plain, ours = np.random.default_rng(0), [], []
    for seed in range(3):
        found = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df, weights=(1, 2), seed=seed, weight=F.col("importance")).collect()}
        took = np.array([found[i] for i in range(1200)])
        assert took.sum() == 800 and set(took) <= {0, 1}
        ours.append([took[weights == w].mean() for w in (1, 2, 8)])
    for _ in range(200):
        took = pareto(rng, p, 800)
        plain.append([took[weights == w].mean() for w in (1, 2, 8)])
    assert np.abs(np.mean(ours, axis=0) - np.mean(plain, axis=0)).max() < 0.05
    assert np.abs(np.mean(plain, axis=0) - [theta * w / (1 + theta * w) for w in (1, 2, 8)]).max() < 0.02
    assert ours[0][0] + 0.1 < ours[0][1] < ours[0][2] - 0.1


def test_capped_source_and_repeated_rows(spark):
    """A source at its cap is taken three times and never ranked; equal rows are drawn apart."""
    rows = [(i, "w " * 20, "small") for i in range(50)] + [(1000 + i, "w " * 20, "big") for i in range(3000)] + [(7, "same words here", "big")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(df, weights=(1, 1)).collect()
    small = [r for r in found if r["source_size"] == 1000]
    assert len(small) == 50 and all(r["copies"] == 3 for r in small)
    same = [r["copies"] for r in found if r["size"] == 3]
    assert len(same) == 2000 and 0 < sum(same) < 2000 * max(same)
    big = [r for r in found if r["source_size"] != 1000]
    assert 0 <= big[0]["target"] - sum(r["taken"] for r in big) <= 20


def test_targets_of_many_sources(spark):
    from tests.llm.test_packing_sharding_mixing import plain_targets

    rng = random.Random(5)
    sizes = {f"s{i:05}": int(rng.paretovariate(0.7)) for i in range(5000)} | {None: 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(plain_targets(sizes))


# ---- chat


def test_turns_with_one_number_follow_the_sql(spark):
    import duckdb

    rng = random.Random(6)
    word = lambda: rng.choice(["a", "a\x01", "b", "", None, "zz", "é"])
    rows = [(c, rng.choice([None, 0, 1]), rng.choice(["user", "bot", None]), word()) for c in range(60) for _ in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_conversations(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    told = con.sql(queries.ORACLE_SQL["op8_snapshot_collapse_chat"]).df()
    assert sorted(map(tuple, told[found.columns.tolist()].values)) == sorted(map(tuple, found.values))


# ---- sharding


@pytest.mark.parametrize("law", ["rows", "key"])
def test_shards_of_a_plain_ring(spark, law):
    """Keys walk on clockwise, one by one, from a full shard to the next point whose shard has room."""
    rows = [(i % 150, f"text {i % 170}") for i in range(400)] + [(3, "same")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.shard_documents(df, 5, law, vnodes=8).collect()
    points = sharding.ring(5 if law == "rows" else 6, 8)
    keyed = numbered(df.select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc")), "t")
    key = F.xxhash64("doc_id", "crc", "_nth") if law == "rows" else F.xxhash64("doc_id")
    slice_ = F.pmod(F.xxhash64(F.lit("slice"), "doc_id", "crc", "_nth"), F.lit(sharding.SLICES))
    keys = keyed.select("doc_id", "crc", F.pmod(key, F.lit(sharding.RING)).alias("place"), slice_.alias("slice"), "_nth").collect()
    assert len(keys) == 500
    arcs = [[] for _ in points]
    for k in keys:
        arcs[next((i for i, (p, _) in enumerate(points) if p >= k["place"]), 0)].append(k)
    for a in arcs:
        a.sort(key=lambda k: (k["slice"], k["place"], k["doc_id"], k["crc"], k["_nth"]))
    want = Counter()
    if law == "key":
        for i, a in enumerate(arcs):
            own = next(points[(i + s) % len(points)][1] for s in range(len(points)) if points[(i + s) % len(points)][1] < 5)
            want.update((k["doc_id"], k["crc"], own, points[i][1]) for k in a)
    else:
        room = sharding.shares(500, 5)
        left = [[] for _ in arcs]
        for i, a in enumerate(arcs):  # first their own shards, then the rest walks on
            for k in a:
                shard = points[i][1]
                if room[shard]:
                    room[shard] -= 1
                    want[k["doc_id"], k["crc"], shard, None] += 1
                else:
                    left[i].append(k)
        for i, a in enumerate(left):
            for k in a:
                shard = next(points[(i + s) % len(points)][1] for s in range(1, len(points)) if room[points[(i + s) % len(points)][1]])
                room[shard] -= 1
                want[k["doc_id"], k["crc"], shard, None] += 1
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in found) == want


def test_few_rows_move_to_one_more_shard(spark, sf):
    docs = table(spark, sf, "documents")
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, n).collect()} for n in (4, 5))
    assert 0.2 * len(one) <= sum(one[i] != two[i] for i in one) <= 0.5 * len(one)
    assert set(two.values()) == set(range(5))


def test_numbered_rows(spark, monkeypatch):
    from linkwright.llm import common

    monkeypatch.setattr(common, "UNFOLD", 8)
    rows = [(1, "a")] * 30 + [(2, None)] * 3 + [(None, "b")] * 9 + [(3, "c")]
    found = numbered(spark.createDataFrame(rows, "id long, x string"), "t").collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((i, x, k)) for (i, x), n in Counter(rows).items() for k in range(n))
