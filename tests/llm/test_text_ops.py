"""WARC, quality, language, chat and the pipeline: round trips, plain versions, held-out accuracy and edge cases."""

import base64
import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import chat, langid, packing, quality, queries, warc
from linkwright.llm.common import materialize, maybe_in, scratch_path, table

# ---- shared helpers


def test_filter_of_ids_loses_none(spark):
    rows = spark.range(0, 5000).withColumn("x", F.lit(1)).union(spark.createDataFrame([(None, 2)], "id long, x int"))
    ids = spark.range(0, 5000, 7)
    found = maybe_in(rows, "id", ids)
    assert found.columns == ["id", "x", "_maybe"]
    got = {r["id"] for r in found.where("_maybe").collect()}
    assert {r["id"] for r in ids.collect()} <= got and len(got) < 1000
    assert maybe_in(rows, "id", ids.limit(0)).where("_maybe").count() == 0


# ---- WARC


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def plain_pages(rows):
    first = {}
    for p, h in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != p
        out.append((p, len(b), sha(b), "revisit" if again else "response", f if again else None))
    return out


def test_round_trip(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    copies = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10**6)
    odd = spark.createDataFrame([(-2, None, None), (-1, "a b\r\nc", ""), (None, "q", "alone"), (None, "q", ""), (-7, "é", "x" * 300_000), (5 * 10**6, "u", "WARC/1.1\r\n\r\n\x00\r\n\r\nWARC/1.0")], "page_id long, url string, html string")
    given = pages.union(copies).union(odd).union(odd.limit(2)).withColumn("payload", F.lit(1)).withColumn("sha", F.lit(1))
    found = [tuple(r) for r in warc.round_trip(given).collect()]
    want = plain_pages([(r["page_id"], r["html"]) for r in given.collect()])
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.round_trip(given.limit(0)).collect() == []


def test_archives_are_ordinary_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "hällo"), (2, None, "hällo")], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and "hällo".encode() in data
    urls = {r["page_id"]: (r["url"], r["record_type"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert urls == {1: ("http://x/", "response"), 2: (None, "revisit")}


def make(i, n=200):
    body = f"<p>{i}</p>".encode() * n
    return warc.record(i, f"u{i}", body, hashlib.sha1(body).digest(), len(body), None, False)


def seen(data):
    out = list(warc.salvage(data))
    ids = [int(re.search(r"\d+", x.fields["warc-record-id"])[0]) for x in out if x.fields]
    return ids, [(x.start, x.end) for x in out if not x.fields]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [gzip.compress(make(i)) if packed else make(i) for i in range(8)]
    data = b"".join(records)
    at = np.cumsum([0, *map(len, records)]).tolist()
    assert seen(data) == (list(range(8)), [])
    hurt = bytearray(data)
    hurt[at[3] - 100] ^= 0xFF
    hurt[at[5] + len(records[5]) // 2] ^= 0xFF
    ids, gaps = seen(bytes(hurt))
    assert ids == [0, 1, 3, 4, 6, 7] and gaps == [(at[2], at[3]), (at[5], at[6])]
    ids, gaps = seen(data[: at[3]] + b"junk WARC/1. \x1f\x8b\x08 junk" + data[at[3] :])
    assert ids == list(range(8)) and gaps == [(at[3], at[3] + 21)]
    ids, gaps = seen(data[: at[7] + 40])
    assert ids == list(range(7)) and gaps == [(at[7], at[7] + 40)]
    ids, gaps = seen(data[at[1] - 30 :])
    assert ids == list(range(1, 8)) and gaps == [(0, 30)]
    assert seen(b"") == ([], []) and seen(b"nothing here") == ([], [(0, 12)])


def test_damage_is_reported(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", f"page {i} " * 500) for i in range(20)], "page_id long, url string, html string").coalesce(1).transform(lambda d: warc.write_archives(d, str(tmp_path / "w")) or d)
    f = next((tmp_path / "w").glob("part-*"))
    data = bytearray(f.read_bytes())
    data[len(data) // 2] ^= 0xFF
    f.write_bytes(bytes(data))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sum(r["record_type"] is not None for r in rows) == 19
    gap = next(r for r in rows if r["record_type"] is None)
    assert gap["reason"] and gap["end"] > gap["start"]


# ---- quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)


def check_measures(docs):
    found = quality.judged(docs, keep=("doc_id", "text")).collect()
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_measures(r["text"])
        assert not (r["base_failed"] and r["kept"])
    return found


def test_measures_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    found = check_measures(docs)
    assert len(found) == docs.count()
    good = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    kept = {r["doc_id"]: r["kept"] or r["base_failed"] for r in found}
    clean = [kept[r["doc_id"]] for r in good.collect()]
    assert np.mean(clean) > 0.98
    bad = [r["kept"] for r in found if r["doc_id"] in {x["doc_id"] for x in table(spark, sf, "labels").where("quality = 0").collect()}]
    assert np.mean(bad) < 0.3


def js(p, q):
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum()
    return np.sqrt(max((part(p) + part(q)) / 2, 0))


def test_distances_follow_a_plain_version(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"], Counter()).update(w if len(w) <= 6 and w.isalpha() else None for w in WORDS.findall(r["text"] or ""))
    refs = {}
    for lang, c in by.items():
        top = sorted(((n, w) for w, n in c.items() if w), key=lambda x: (-x[0], x[1].encode()))[: quality.N_COMMON]
        shares = np.array([n for n, _ in top]) / sum(c.values())
        refs[lang] = [w for _, w in top], np.append(shares, 1 - shares.sum())
    found = {r["doc_id"]: r["word_distance"] for r in quality.judged(docs).collect()}
    for r in rows[:80]:
        w = WORDS.findall(r["text"] or "")
        if len(w) >= quality.MIN_JUDGED_WORDS:
            common, ref = refs[r["lang"]]
            c = Counter(w)
            counts = np.array([c[x] for x in common])
            assert found[r["doc_id"]] == pytest.approx(js(np.append(counts, len(w) - counts.sum()) / len(w), ref), abs=1e-9)
        else:
            assert found[r["doc_id"]] is None


def test_quality_edges(spark):
    given = [(1, None, "en"), (2, "", None), (3, "a b c a b c a b c " * 4000, "en"), (4, " \x1c  x\n\nx\nx \n", "xx"), (5, "same same same", "en"), (5, "same same same", "en"), (None, "𝔘 # *" * 60, None)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("own", F.lit(1)).withColumn("_words", F.lit(1))
    assert len(check_measures(df)) == len(given)
    assert quality.judged(df.limit(0)).collect() == []


# ---- language


def test_codewords():
    for n in (1, 2, 4, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1, 1}
    four = langid.codewords(4).astype(int)
    assert four.shape == (4, 7) and min((7 - four[a] @ four[b]) // 2 for a in range(4) for b in range(a)) == 4


def test_decoding_corrects_a_bit():
    code = langid.codewords(4).astype(float)
    trust = np.ones_like(code)
    for i in range(4):
        for bit in range(7):
            f = 5 * code[i]
            f[bit] *= -1
            best, score = langid.decode(f[None, :], code, trust)
            assert best[0] == i and 0 < score[0] <= 1


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    found = {r["doc_id"]: r for r in langid.language_predictions(docs).collect()}
    import zlib

    right = []
    for r in docs.collect():
        f = found[r["doc_id"]]
        assert f["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= f["score"] <= 1
        if f["held_out"]:
            right.append(f["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.97


def test_held_out_rows_teach_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    spoilt = docs.withColumn("lang", F.when(langid._fold() == 1, F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: r["lang_pred"] for r in langid.language_predictions(d).collect()} for d in (docs, spoilt))
    assert a == b


def test_language_edges(spark, sf):
    more = [(10**7, None, "en"), (10**7 + 1, "123 !? ٣", "en"), (10**7 + 2, "", None), (None, "the and of", "en"), (10**7 + 3, "the " * 50_000, None), (10**7 + 4, "x", "en")]
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string")).withColumn("score", F.lit("s")).withColumn("count", F.lit(1))
    found = {r["doc_id"]: r for r in langid.language_predictions(docs).collect()}
    assert [found[10**7 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert found[None]["lang_pred"] == "en" and not found[None]["held_out"] and found[10**7 + 3]["lang_pred"] == "en"
    assert langid.language_predictions(docs.limit(0)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).limit(3)
    assert {r["lang_pred"] for r in langid.language_predictions(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(2)).columns == ["doc_id", "text", "lang", "count", "lang_pred", "score", "ambiguous"]


# ---- chat


def plain_chat(rows):
    """conv_id -> (turns, copies) of conversations that are no proper prefix of another, and no later copy."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0))] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in convs.values()):
            continue
        same = [o for o, w in convs.items() if w == v]
        if c == min(same):
            out[c] = (len(v), len(same))
    return out


def test_chat(spark, sf):
    import duckdb

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    snaps = turns.where("turn < 2").withColumn("conv_id", F.col("conv_id") + 10**6)
    copies = turns.where("conv_id % 5 = 0").withColumn("conv_id", F.col("conv_id") + 2 * 10**6).withColumn("turn", F.col("turn") * 3 + 1)
    every = turns.union(snaps).union(copies)
    found = chat.format_conversations(every).toPandas()
    want = plain_chat([tuple(r) for r in every.collect()])
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in found.itertuples()} == want
    con = duckdb.connect()
    con.register("conversations", every.toPandas())
    told = con.sql(queries.ORACLE_SQL["op8_snapshot_collapse_chat"]).df()
    assert sorted(map(tuple, told[found.columns.tolist()].values)) == sorted(map(tuple, found.values))


def test_chat_edges(spark):
    given = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, "yes"), (3, 0, "user", None), (4, 0, "user", ""), (5, None, "user", "hi"), (5, 0, "bot", "no"), (None, 0, "user", "lost"), (6, 0, "user", "x" * 200_000), (7, 0, "user", "re"), (7, 0, "user", "re"), (8, 0, "user", "re")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("h1", F.lit(1)).withColumn("told", F.lit(1))
    found = {r["conv_id"]: r["text"] for r in chat.format_conversations(df).collect()}
    assert sorted(found) == [2, 3, 4, 5, 6, 7]
    assert found[2] == "<|user|>\nhi\n<|unknown|>\nyes\n" and found[3] == found[4] == "<|user|>\n\n"
    assert found[5] == "<|user|>\nhi\n<|bot|>\nno\n" and found[7] == "<|user|>\nre\n" * 2
    assert chat.format_conversations(df.limit(0)).collect() == []


# ---- pipeline


def test_pipeline(spark, sf):
    """Stage by stage against plain versions of each stage's decision."""
    import corpus_pipeline as p
    from tests.llm.test_near import brute_classes, brute_cover

    docs = table(spark, sf, "documents")
    assert [n for n, _ in p.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "best-fit packing"]
    before, steps = docs, []
    for _, stage in p.STAGES[:-1]:
        before = materialize(stage(spark, before, sf), "t")
        assert before.columns == docs.columns
        steps.append({r["doc_id"]: r for r in before.collect()})
    given = {r["doc_id"]: r for r in docs.collect()}
    lost = set(given) - set(steps[0])
    assert all(not re.search(r"[^\W\d_]", given[i]["text"] or "") for i in lost)
    classes = brute_classes({i: r["text"] for i, r in steps[0].items()})
    assert set(steps[1]) == {i for i, c in classes.items() if i == c}
    cover = brute_cover({i: r["text"] for i, r in steps[1].items()})
    for i, r in steps[1].items():
        if not cover[i]:
            assert steps[2][i] == r
        elif i in steps[2]:
            assert steps[2][i]["n_chars"] == len(steps[2][i]["text"]) < r["n_chars"]
    mixed = Counter(r["doc_id"] for r in before.collect())
    assert set(mixed) <= set(steps[2]) and max(mixed.values()) <= 3
    rows = p.run(spark, sf).collect()
    encode = packing.encoder()
    tokens = sum(n * (len(encode(steps[2][i]["text"] or "")) + 1) for i, n in mixed.items())
    assert sum(r["length"] for r in rows) == tokens
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == mixed


def test_pipeline_of_nothing_and_edges(spark, sf):
    import corpus_pipeline as p

    base = table(spark, sf, "documents").limit(50)
    odd = spark.createDataFrame([(None, "the and of", "en", None, 1), (10**8, None, None, "a", None), (10**8 + 1, "the and of", "en", "a", 3), (10**8 + 1, "the and of", "en", "a", 3)], base.schema)
    for docs in (base.limit(0), base.union(odd).withColumn("copies", F.lit(1)).withColumn("kept", F.lit(1))):
        n = docs.count()
        for _, stage in p.STAGES:
            docs = materialize(stage(spark, docs, sf), "e")
        assert (docs.count() > 0) == (n > 0)


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
