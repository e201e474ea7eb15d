import math
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from quire.functions.stemming import stem, stems, words
from quire.operators import substring_index, text_index
from quire.operators.substring_index import SubstringIndex
from quire.operators.text_index import TextIndex
from quire.sources import tables

#: Words and stems of the published examples.
KNOWN = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit digitizer digit operator oper hopefulness hope electricity electr probate probat rate rate controlling control roll roll adoption adopt replacement replac".split()


def test_stems_of_the_published_examples():
    assert {w: stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))
    assert stems("The Élèves' ponies, x2 日本 _a") == ["the", "elev", "poni", "x2", "日本", "a"] and stems(None) == []


def test_stems_as_the_exported_bundle_has_them(spark):
    """The same terms as the full-text table of the exported SQLite bundle (porter unicode61)."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    r = random.Random(1)
    ends = ["s", "es", "ed", "ing", "ation", "izer", "ational", "fulness", "iveness", "ly", "ement", "ion", "y", "ies", "ability", "logy", "ll", "e", "ically"]
    texts += [" ".join("".join(r.choice("aeioubcdlmnprstwxy") for _ in range(r.randint(1, 6))) + r.choice(ends) for _ in range(3000))]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for text in texts:
        db.execute("INSERT INTO t VALUES (?)", (text,))
    assert {x[0] for x in db.execute("SELECT term FROM v")} == {s for t in texts for s in stems(t)}


def corpus():
    r = random.Random(2)
    vocabulary = [f"w{int(300 * r.random() ** 3)}" for _ in range(400)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 30, 90])))) for i in range(700)]
    return rows + [(7000, None), (7001, ""), (7002, "!!"), (7003, "w1 " * 4000), (7004, rows[0][1]), (7005, rows[0][1])]


def plain_bm25(rows, query, k, every=False):
    texts = {i: words(t) for i, t in rows}
    sizes = [len(t) for t in texts.values() if t]
    mean, out = sum(sizes) / len(sizes), []
    asked = set(words(query))
    df = {w: sum(w in set(t) for t in texts.values()) for w in asked}
    for i, t in texts.items():
        hit = [w for w in asked if w in set(t)]
        score = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in hit)
        if hit and (not every or len(hit) == len(asked)):
            out.append((-round(score, 9), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(text_index, "SLICE", 100)
    patch.setattr(text_index, "BLOCK", 8)
    folder = str(tmp_path_factory.mktemp("words"))
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)
    yield TextIndex.build(df, folder + "/index", "doc_id", "text")
    patch.undo()


QUERIES = [(1, "w0 w250"), (2, "W299"), (3, "w1 w2 w3 w4 w5 w200"), (4, "nothing here"), (5, ""), (6, None), (7, "w7 w7 nothing")]


def test_search_equals_plain_scores(spark, small):
    index = TextIndex.open(spark, small.folder)
    assert index == small and index.slices == 8
    asked = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    for every in (False, True):
        got = {}
        for r in sorted(index.search(asked, 5, every).collect(), key=lambda r: r["place"]):
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {i: want for i, q in QUERIES if (want := plain_bm25(corpus(), q, 5, every))}


def test_blocks_that_cannot_matter_are_not_read(spark, small):
    reads = lambda *q: small.blocks_read(spark.createDataFrame(list(enumerate(q)), "query_id long, query_text string"), 3)
    needed, whole = reads("w0", "w1")
    assert needed < whole / 4
    needed, whole = reads("w0 w250", "w1 w2 w3 w4 w5 w200")
    assert needed < 0.8 * whole
    widest = spark.read.parquet(small.folder + "/postings").select(F.max(F.size("keys"))).first()[0]
    assert widest <= 8


def test_phrases(spark, small):
    rows = corpus()
    phrases = [(n, " ".join(rows[n][1].split()[a:b])) for n, a, b in ((0, 0, 3), (1, 0, 2), (2, 1, 2), (40, 0, 3))] + [(900, "w1 w1 w1"), (901, "zz w1"), (902, "")]
    asked = spark.createDataFrame(phrases, "query_id long, query_text string")
    want = {}
    for q, p in phrases:
        w = words(p)
        for i, t in rows:
            t = words(t)
            n = sum(t[a : a + len(w)] == w for a in range(len(t) - len(w) + 1)) if w else 0
            if n:
                want[q, i] = n
    assert {(r["query_id"], r["doc_id"]): r["n"] for r in small.phrases(asked).collect()} == want and (900, 7003) in want


def test_stemmed_index_meets_inflected_words(spark, tmp_path):
    df = spark.createDataFrame([(1, "He was connecting cables"), (2, "A connection"), (3, "unrelated")], "doc_id long, text string")
    index = TextIndex.build(df, str(tmp_path / "index"), "doc_id", "text", kind="stems")
    asked = spark.createDataFrame([(1, "connected cable")], "query_id long, query_text string")
    assert [(r["doc_id"], r["place"]) for r in index.search(asked, 5).orderBy("place").collect()] == [(1, 1), (2, 2)]
    none = TextIndex.build(df.filter("doc_id > 5"), str(tmp_path / "none"), "doc_id", "text")
    assert none.search(asked, 5).count() == 0 and none.rows == 0


def test_substrings_equal_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "SLICE", 90)
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abÉc dß") for _ in range(r.choice([0, 1, 5, 200])))) for i in range(500)] + [(900, None), (901, "x" * 50_000 + "needle")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    SubstringIndex.build(df, str(tmp_path / "index"), "doc_id", "text")
    index = SubstringIndex.open(spark, str(tmp_path / "index"))
    asked = [(n, "".join(r.choice("ABéc d") for _ in range(k))) for n, k in enumerate([1, 2, 3, 3, 4, 5, 6, 8, 20])] + [(50, "xNeedle"), (51, ""), (52, None), (53, "zzz"), (54, "%"), (55, rows[3][1])]
    got = {(x["query_id"], x["doc_id"]) for x in index.search(spark.createDataFrame(asked, "query_id long, query_text string")).collect()}
    assert got == {(q, i) for q, a in asked if a for i, t in rows if t is not None and a.lower() in t.lower()} and (50, 901) in got


def test_hybrid_over_three_indexes(spark, tmp_path):
    from quire.operators.vector_index import VectorIndex
    from quire.plans.search import indexed_hybrid

    texts = {"a_0": "One fish two fish", "a_1": "red fish blue", "b_0": "a boat on water", "c_0": "fish and boats on blue water"}
    vectors = {"a_0": [0.0, 1.0], "a_1": [0.1, 1.0], "b_0": [1.0, 0.0], "c_0": [0.9, 0.1]}
    rows = [(c, c[0], int(c[2]), t, vectors[c]) for c, t in texts.items()]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_uuid string, chunk_index int, content string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "FISH"), (2, [1.0, 0.0], "the blue water that boats and fish like is longer than any chunk"), (3, [0.0, 1.0], "")], "query_id long, query_vector array<double>, query_text string")
    folder = str(tmp_path)
    built = VectorIndex.build(chunks, folder + "/v", "chunk_id"), SubstringIndex.build(chunks, folder + "/s", "chunk_id"), TextIndex.build(chunks, folder + "/w", "chunk_id")
    got = {}
    for r in indexed_hybrid(chunks, asked, 2, *built, candidates=2).orderBy("query_id", F.desc("score")).collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    # 1: vectors b_0, c_0; held by a_0, a_1; words a_0 (twice), a_1: both lists of words lift a_0 over the nearest
    assert got[1] == [("a_0", round(2 / 61, 9)), ("a_1", round(2 / 62, 9))]
    # 2: no chunk holds the whole text; words put c_0 first, vectors second
    assert got[2][0] == ("c_0", round(1 / 61 + 1 / 62, 9)) and got[3] == [("a_0", round(1 / 61, 9)), ("a_1", round(1 / 62, 9))]


def test_no_posting_becomes_a_row_for_a_query(spark, small):
    """A slice's postings and the queries meet as they are; equal queries are one."""
    asked = spark.createDataFrame([(1, "w0 w1"), (2, "w1 W0"), (3, "w0 w1")], "query_id long, query_text string")
    found = small.search(asked, 3)
    assert "explode(arrays_zip" not in found._jdf.queryExecution().toString()
    places = {q: [r["doc_id"] for r in found.filter(f"query_id = {q}").orderBy("place").collect()] for q in (1, 2, 3)}
    assert places[1] == places[2] == places[3] == plain_bm25(corpus(), "w0 w1", 3)


def test_common_grams_are_no_rows_either(spark, tmp_path):
    df = spark.createDataFrame([(i, f"the same {i}") for i in range(30)], "doc_id long, text string")
    index = SubstringIndex.build(df, str(tmp_path / "index"), "doc_id", "text")
    asked = spark.createDataFrame([(1, "the same 1"), (2, "The Same 1"), (3, "same 29")], "query_id long, query_text string")
    assert "explode(keys" not in index.candidates(asked.filter("query_id <> 2"))._jdf.queryExecution().toString()
    found = {(r["query_id"], r["doc_id"]) for r in index.search(asked).collect()}
    assert found == {(q, i) for q in (1, 2) for i in (1, *range(10, 20))} | {(3, 29)}


def test_many_substrings_are_found_in_one_pass_without_candidates(spark, tmp_path, monkeypatch):
    """No pair is written before it is compared, and no text moves: all that a search shuffles or stores are its queries."""
    r = random.Random(7)
    word = lambda k: "".join(r.choice("abÉc dß中") for _ in range(k))
    rows = [(i, word(r.choice([0, 1, 2, 5, 40, 300]))) for i in range(300)] + [(900, None), (901, "x" * 50_000 + "needle"), (902, "aaaa" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = SubstringIndex.build(df, str(tmp_path / "index"), "doc_id", "text")
    asked = [(n, word(r.choice([1, 2, 3, 4, 5, 7, 8, 12]))) for n in range(150)] + [(500 + i, t[2:40].upper()) for i, t in rows[:200]]
    asked += [(800, "xNeedle"), (801, ""), (802, None), (803, "zzz"), (804, "aaa"), (805, "AAA"), (806, "x" * 3000 + "needle"), (807, "x" * 50_001)]
    want = sorted((q, i) for q, a in asked if a for i, t in rows if t is not None and a.lower() in t.lower())
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    written = []
    monkeypatch.setattr(substring_index, "table", lambda df, name, keep=substring_index.table: written.append(name) or keep(df, name))
    for piece, pairs, at_once in ((1 << 18, 1 << 16, 16_000_000), (100, 7, 3000)):
        for name, value in (("PIECE", piece), ("PAIRS", pairs), ("ASKED_BYTES", at_once)):
            monkeypatch.setattr(substring_index, name, value)
        found = index.search(queries)
        assert sorted((x["query_id"], x["doc_id"]) for x in found.collect()) == want and {(800, 901), (804, 902), (805, 902), (806, 901)} <= set(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert set(written) == {"queries", "different"}


def test_shuffles_go_when_a_table_is_written(spark, tmp_path):
    manager, name = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = set(str(manager.getAllFiles()).split(", ")), spark.conf.get(name)
    out = tables.table(spark.range(10_000).repartition(3, "id"), "rows")
    tables.stored(spark.range(100).repartition(2, "id").withColumn("b", F.lit(1)), str(tmp_path / "by"), by=("b",))
    for _ in range(50):  # files go in the background
        left = [x for x in set(str(manager.getAllFiles()).split(", ")) - before if "/shuffle_" in x]
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == setting
    assert out.count() == 10_000 and spark.read.parquet(str(tmp_path / "by")).count() == 100
