import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import retrieval, vector_index
from quire.operators.vector_index import VectorIndex, recall_of


def clustered(n, width=16, groups=12, seed=1, noise=0.35):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    share = np.r_[0.34, np.full(groups - 1, 0.66 / (groups - 1))]  # one hot group
    return middles[rng.choice(groups, n, p=share)] + noise * rng.normal(size=(n, width))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000))]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0]), (9003, [None] * 16), (9004, [float("nan")] + [1.0] * 15)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(6)


def as_set(df):
    return {(r["query_id"], r["vec_id"], r["place"]) for r in df.collect()}


def test_index_against_exact_search(spark, vectors, tmp_path):
    built = VectorIndex.build(vectors, str(tmp_path / "index"), "vec_id")
    index = VectorIndex.open(spark, str(tmp_path / "index"))
    assert (built.indexed, built.left_out) == (3000, 5) == (index.indexed, index.left_out) and np.allclose(built.centres, index.centres)
    assert index.rows(spark).count() == 3000 and index.probes < len(index.centres) / 2
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = retrieval.nearest(asked, vectors, 10, "vec_id")
    assert as_set(index.search(asked, 10, probes=len(index.centres))) == as_set(exact)
    found = recall_of(index.search(asked, 10), exact, "vec_id").agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert found >= 0.9
    assert recall_of(index.search(asked, 10, probes=1), exact, "vec_id").agg(F.sum("n_found") / F.sum("n_exact")).first()[0] < found


def test_many_queries_join_the_lists(spark, vectors, tmp_path, monkeypatch):
    index = VectorIndex.build(vectors, str(tmp_path / "index"), "vec_id")
    asked = vectors.filter("vec_id % 100 = 0 or vec_id >= 9000").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"))
    few = as_set(index.search(asked, 5))
    monkeypatch.setattr(vector_index, "MATRIX", 1)
    assert as_set(index.search(asked, 5)) == few and {q for q, _, _ in few} == {str(i) for i in range(0, 3000, 100)}


def test_only_the_lists_looked_into_are_read(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors, str(tmp_path / "index"), "vec_id")
    one = vectors.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = index.search(one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list")


def test_added_rows_are_found(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors.filter("vec_id < 2000"), str(tmp_path / "index"), "vec_id")
    index.add(vectors.filter("vec_id >= 2000"))
    asked = vectors.filter("vec_id between 2500 and 2510").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert {(r["query_id"], r["vec_id"]) for r in index.search(asked, 1).collect()} == {(i, i) for i in range(2500, 2511)}
    assert index.rows(spark).count() == 3000


def test_tables_without_usable_vectors_are_refused(spark, vectors, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(vectors.filter("vec_id in (9000, 9001)"), str(tmp_path / "index"), "vec_id")


def test_odd_lengths_do_not_break_the_exact_search(spark, vectors):
    asked = spark.createDataFrame([(1, [1.0] * 16), (2, [1.0, 1.0]), (3, [0.0] * 16), (4, None)], "query_id long, query_vector array<double>")
    found = as_set(retrieval.nearest(asked, vectors, 3, "vec_id"))
    assert {q for q, _, _ in found} == {1, 2} and (2, 9002, 1) in found and len(found) == 4


def test_nearest_of_each_owner(spark, monkeypatch):
    """One owner has 30 % of the rows; blocks are small, so owners of many rows are split."""
    v = clustered(1500, width=8, seed=3)
    owners = ["big" if i % 10 < 3 else None if i % 10 == 3 else f"o{i % 97}" for i in range(1500)]
    rows = [(i, o, x.tolist(), i % 7 if i % 7 else None) for i, (o, x) in enumerate(zip(owners, v, strict=True))]
    df = spark.createDataFrame(rows, "memory_id long, user_id string, embedding array<double>, expires int")
    live = df.filter("expires is null or expires > 3")
    asked = df.filter("memory_id % 5 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.col("embedding").alias("query_vector"))
    got = {(r["query_id"], r["place"]): r["memory_id"] for r in retrieval.nearest_of_owner(asked, live, 4, "memory_id", block=64).collect()}
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    want = {}
    for q in range(0, 1500, 5):
        own = [i for i, o, _, e in rows if o == owners[q] and (e is None or e > 3)]
        order = sorted(own, key=lambda i: (round(1 - float(unit[i] @ unit[q]), 12), i))[:4]
        want |= {(q, n): i for n, i in enumerate(order, 1)}
    assert got == want
    assert retrieval.nearest_of_owner(asked.filter("false"), live, 4, "memory_id").count() == 0


def test_queries_without_hits_are_refused(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "query_id long, chunk_id string")
    assert sorted(tuple(r) for r in retrieval.answerable(asked, hits).collect()) == [(1, 2, None), (2, 0, retrieval.NO_CONTEXT)]


def test_recall_and_semantic_cache(spark):
    rows = [("m1", "a", "likes tea", [1.0, 0.0], 10), ("m2", "a", "likes cake", [1.0, 0.1], None), ("m3", "a", "gone", [1.0, 0.0], 5), ("m4", "b", "other", [1.0, 0.0], None), ("m5", "a", "far", [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "memory_id string, user_id string, memory_text string, embedding array<double>, expires_at int")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "c", [1.0, 0.0])], "query_id long, user_id string, query_vector array<double>")
    got = {r["query_id"]: (r["keys"], r["block"]) for r in retrieval.recalled(asked, df, F.lit(7), k=2).collect()}
    assert got == {1: (["m1", "m2"], "- likes tea\n- likes cake"), 2: (["m4"], "- other")}
    cached = df.select(F.col("memory_id").alias("cache_id"), "user_id", "embedding", "expires_at", F.array(F.col("memory_id")).alias("sources"))
    hits = lambda allowed=None: {r["query_id"]: r["cache_id"] for r in retrieval.semantic_hits(asked, cached, F.lit(7), allowed=allowed).collect()}
    assert hits() == {1: "m1"}
    assert hits(spark.createDataFrame([("m2",)], "doc_uuid string")) == {} and hits(spark.createDataFrame([("m1",)], "doc_uuid string")) == {1: "m1"}


def test_only_the_drawn_vectors_reach_the_driver(spark, tmp_path):
    """Each of 12 tasks has more rows than are drawn; hashes are chosen before vectors move, with ties and rows that are left out."""
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3600, width=100))] + [(-1, None), (-2, [0.0] * 100), (-3, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(12).localCheckpoint()
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(name, "1g")
    conf.set(name, "1m")  # the sample is 0.16 MB, and the least of each task together are 1.9 MB
    try:
        index = VectorIndex.build(df, str(tmp_path / "index"), "vec_id", sample=200)
    finally:
        conf.set(name, before)
    drawn = df.filter("vec_id >= 0").orderBy(F.xxhash64("vec_id")).limit(200).collect()
    assert index.indexed == 3600 and np.allclose(index.centres, vector_index.fitted_centres(np.array([r["embedding"] for r in drawn]), 25))
    twice = df.unionByName(df.filter("vec_id = 5"))
    some = twice.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    hashes = some.filter("key >= 0").select(F.xxhash64("key").alias("hash"))
    for most in (1, 7, 5000):
        want = [r["vector"] for r in some.filter("key >= 0").orderBy(F.xxhash64("key"), "key").limit(most).collect()]
        assert np.array_equal(vector_index._drawn(some, hashes, most, 100), np.array(want))


def test_vectors_are_made_for_the_index_and_kept_nowhere_else(spark, tmp_path, monkeypatch):
    """In parts, one after the other; each row's vector is made twice and not again for filters, and the index is the same."""
    odd = {3: None, 4: [0.0] * 6, 5: [1.0], 6: [float("nan")] * 6, 7: [None] * 6, 8: [], 9: [float("inf")] * 6}
    known = {i: odd.get(i, v.tolist()) for i, v in enumerate(clustered(400, width=6))}
    calls = spark.sparkContext.accumulator(0)

    def vectors(texts):
        calls.add(len(texts))
        return texts.map(lambda t: known[int(t[1:])])

    given = spark.createDataFrame([(f"t{i}", f"t{i}", v) for i, v in known.items()], "chunk_id string, content string, embedding array<double>").repartition(3).localCheckpoint()
    plain = VectorIndex.build(given, str(tmp_path / "given"), "chunk_id")
    monkeypatch.setattr(vector_index, "NUMBERS", 600)
    fewer = VectorIndex.build(given, str(tmp_path / "parts"), "chunk_id")
    made = VectorIndex.build(given.drop("embedding"), str(tmp_path / "made"), "chunk_id", embed=lambda rows: rows.withColumn("embedding", F.pandas_udf(vectors, "array<double>")("content")))
    assert (plain.indexed, plain.left_out) == (fewer.indexed, fewer.left_out) == (made.indexed, made.left_out) == (393, 7)
    assert np.array_equal(made.centres, fewer.centres) and 2 * 400 <= calls.value <= 2 * 400 + 120  # with the sample, and what is left out of it
    lists = lambda index: sorted((r["key"], r["list"], tuple(r["vector"])) for r in index.rows(spark).collect())
    assert lists(made) == lists(fewer) and {(k, v) for k, _, v in lists(plain)} == {(k, v) for k, _, v in lists(made)}


def test_sizes_of_usable_vectors_equal_the_expression(spark):
    some = [[1.0, 0.0], [0.0, -0.0], None, [], [None, 1.0], [float("nan"), 1.0], [float("-inf")], [2.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(some)], "key int, vector array<double>").coalesce(1)
    want = {r["key"]: r["size"] for r in df.select("key", F.when(vector_index.usable("vector"), F.size("vector")).otherwise(0).alias("size")).collect()}
    assert {r["key"]: r["size"] for r in df.mapInArrow(vector_index._sizes, "key int, size int").collect()} == want
