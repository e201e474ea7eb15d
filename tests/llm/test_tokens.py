import random
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.packing import closest_fill, cut_pieces, minimum_bin_slack, pack
from quire.llm.token_counts import length_histogram, length_quantile, truncated_totals
from quire.llm.token_store import check_manifest, cuts, merkle, read_store, write_store
from quire.llm.tokens import Encoder, word_bpe

TEXTS = ["Hello world, it's FINE!", None, "", "naïve café ½ ②", "a\x1cb \x85c", "İstanbul ΣΑΣ", "<|endoftext|> x", "don't 'll 've ...'s", "１２ 12 3.4", "\u200bzero\ufeff", "e\u0301 u\u0308", "日本語 テスト", "tab\tnew\nline", " " * 50, "x" * 300, "😀 ok"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(word_bpe())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(encoder):
    random.seed(5)
    letters = "aAbÉé ß'.!?<|>\t0129ſØ×÷İµ日\u0301-_"
    some = TEXTS + ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(1500)]
    for _ in range(2):  # unseen, then remembered
        for text in some:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(encoder, text), repr(text)


def documents(spark, encoder):
    random.seed(3)
    words = [f"w{n}" for n in range(300)]
    rows = list(enumerate(TEXTS)) + [(100 + n, " ".join(random.choices(words, k=random.choice([3, 40, 900, 2500])))) for n in range(60)]
    rows += [(500 + n, rows[-1][1]) for n in range(20)]
    return rows, spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")


def test_packing(spark, encoder):
    rows, df = documents(spark, encoder)
    found = pack(cut_pieces(df, word_bpe())).collect()
    ids = {i: plain(encoder, t) + [1] for i, t in rows}
    got, windows = {}, {}
    for r in found:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"] and piece == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {i: len(x) for i, x in ids.items()}
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(got.values())
    assert len(windows) * 2048 <= total * 1.1 + 2 * 2048
    assert pack(cut_pieces(df.filter("doc_id < -1"), word_bpe())).count() == 0


def test_closest_fill_against_all_subsets():
    random.seed(1)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(4)}
        room = random.randint(0, 80)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        used = closest_fill(counts, room)
        assert sum(n * c for n, c in used.items()) == max(sums) and all(c <= counts[n] for n, c in used.items())


def test_minimum_bin_slack_places_all():
    random.seed(2)
    histogram = {random.randint(1, 2047): random.randint(1, 50) for _ in range(200)}
    left = dict(histogram)
    for times, used in minimum_bin_slack(histogram):
        assert sum(n * c for n, c in used.items()) <= 2048
        for n, c in used.items():
            left[n] -= times * c
    assert not any(left.values())


def test_length_histogram(spark, encoder):
    rows, df = documents(spark, encoder)
    sizes = [len(plain(encoder, t)) + 1 for _, t in rows]
    hist = length_histogram(df, word_bpe())
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs"] == sizes.count(n) and r["docs_longer"] == sum(s > n for s in sizes) and r["tokens_longer"] == sum(s for s in sizes if s > n)
        assert r["truncated_total"] == sum(min(s, n) for s in sizes) and abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-9
    assert {r[0]: r[1] for r in truncated_totals(hist, [1, 100, 5000]).collect()} == {n: sum(min(s, n) for s in sizes) for n in (1, 100, 5000)}
    assert length_quantile(hist, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    assert length_histogram(df.filter("doc_id < -1"), word_bpe()).count() == 0


def test_store_round_trip(spark, encoder, tmp_path):
    rows, df = documents(spark, encoder)
    folder = str(tmp_path / "store")
    write_store(df, folder, word_bpe(), shards=3)
    found = {r["doc_id"]: r for r in read_store(spark, folder).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = plain(encoder, text) + [1]
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == ids and found[i]["start"] == start and found[i]["n_tokens"] == len(ids)
        assert zlib.crc32(found[i]["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert check_manifest(spark, folder).count() == 0
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() > 0
    # a changed chunk is found
    bad = chunks.withColumn("ids", F.concat("ids", F.lit(b"\x01\x00")))
    bad.write.parquet(f"{folder}/changed")


    shutil.rmtree(f"{folder}/chunks")
    shutil.move(f"{folder}/changed", f"{folder}/chunks")
    with pytest.raises(Exception, match="differs from its digest"):
        read_store(spark, folder).collect()


def replaced(spark, folder, part, keep):
    """The rows of a part of a store that ``keep`` lets stay, written in its place."""
    rows = spark.read.parquet(f"{folder}/{part}").filter(keep)
    writer = rows.write.partitionBy("shard") if part == "docs" else rows.write
    writer.parquet(f"{folder}/kept")
    shutil.rmtree(f"{folder}/{part}")
    shutil.move(f"{folder}/kept", f"{folder}/{part}")


def test_store_misses_nothing_unseen(spark, encoder, tmp_path):
    """A lost document, chunk, shard or manifest entry fails; null ids come first, and repeated rows are kept."""
    rows, _ = documents(spark, encoder)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "no id", "x"), (rows[3][0], rows[3][1], "y")], "doc_id long, text string, ids string")
    for part, keep, match in (
        ("docs", "row not in (select min(row) + 1 from d where shard = 1)", "differs from the manifest"),
        ("docs", "shard <> 2", "shard 2 differs from the manifest"),
        ("manifest", "shard <> 0", "shard 0 differs from the manifest"),
        ("chunks", "digest not in (select min(digest) from c)", "differs from its digest"),
    ):
        folder = str(tmp_path / f"{part}{len(keep)}")
        write_store(df, folder, word_bpe(), shards=3)
        whole = read_store(spark, folder)
        assert whole.count() == len(rows) + 2 and whole.filter("start = 0").first()["doc_id"] is None
        if "select" in keep:
            inner = spark.read.parquet(f"{folder}/{part}")
            keep = f"row <> {inner.filter('shard = 1').agg(F.min('row') + 1).first()[0]}" if part == "docs" else F.col("digest") != inner.agg(F.min("digest")).first()[0]
        replaced(spark, folder, part, keep)
        with pytest.raises(Exception, match=match):
            read_store(spark, folder).collect()


def test_shortcut_is_decided_by_settings(tmp_path):
    from tokenizers import Tokenizer, normalizers

    assert Encoder(word_bpe()).simple
    other = Tokenizer.from_file(word_bpe())
    other.normalizer = normalizers.Sequence([normalizers.NFC()])
    path = str(tmp_path / "word_bpe_49k.json")
    other.save(path)
    one = Encoder(path)
    assert not one.simple and np.frombuffer(one.encode("Some Words HERE"), "<u4").tolist() == other.encode("Some Words HERE", add_special_tokens=False).ids


def test_memory_keeps_what_is_met():
    random.seed(5)
    whole, small = Encoder(word_bpe()), Encoder(word_bpe(), 50)
    for _ in range(200):
        text = " ".join(random.choices(["the", "cat's", "Ünïcode", "x1y2", "don't,", "a<|b"] + [f"w{n}" for n in range(200)], k=60))
        assert small.encode(text) == whole._whole(text)
    assert len(small.pieces) <= 50 and len(small.pieces.old) <= 50


def test_empty_store(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_store(spark.createDataFrame([], "doc_id long, text string"), folder, word_bpe(), shards=2)
    assert read_store(spark, folder).count() == 0


def test_cuts_follow_content():
    random.seed(4)
    passage = np.array(random.choices(range(49000), k=6000), "<u4")
    one, two = np.concatenate([passage[:500], passage]), np.concatenate([np.arange(77, dtype="<u4"), passage])
    chunks = lambda x: [x[a:b].tobytes() for a, b in zip([0, *cuts(x)], cuts(x))]
    assert b"".join(chunks(one)) == one.tobytes() and len(set(chunks(one)) & set(chunks(two))) >= 3
    assert merkle([b"a", b"b", b"c"]) != merkle([b"a", b"c", b"b"])


def test_packing_leaves_other_columns_alone(spark):
    names = ["piece", "part", "within", "before", "place"]
    pieces = spark.range(40).select(((F.col("id") * 37) % 16 + 1).alias("length"), *(F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names))
    found = pack(pieces, capacity=16)
    assert found.columns == ["length", *names, "sequence_id", "offset"]
    rows = found.collect()
    assert len(rows) == 40 and all(len({r[n][len(n) :] for n in names}) == 1 for r in rows)
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 16
