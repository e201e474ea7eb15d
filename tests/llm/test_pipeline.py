"""Each stage of the pipeline on its own input, against what a plain version keeps."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import toxicity as tox
from quire.llm.ngram_join import shingles_of
from quire.llm.queries import oracle_sql, queries
from quire.llm.tokens import Encoder, word_bpe


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(21)
    words = [f"v{n}" for n in range(600)]
    rows = []
    for n in range(500):
        text = random.choices(words, k=random.choice([30, 90, 200]))
        if n % 5 == 0:
            text[7] = random.choice(["nastyone", "nastytwo"])
        rows.append([n, " ".join(text), "en", "s", 0])
    rows += [[600 + n, rows[n * 3 + 1][1].replace(" ", "  "), "en", "s", 0] for n in range(40)]  # copies but for blanks
    for n in range(40):  # near copies
        text = rows[n * 3 + 2][1].split()
        text[len(text) // 2] = "changed"
        rows.append([700 + n, " ".join(text), "en", "s", 0])
    items = [(n, " ".join(random.choices(words, k=25))) for n in range(5)]
    rows += [[800 + n, rows[n][1] + " " + items[n % 5][1] + " tail", "en", "s", 0] for n in range(1, 20)]
    rows += [[900, None, "en", "s", 0], [901, "", "en", "s", 0], [902, "!!", "en", "s", 0]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, int(n % 5 == 0)) for n in range(500)], "doc_id long, quality int").withColumnRenamed("quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(items)


def normal(text):
    return (text or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))


def test_stages(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.table(stage(spark, docs, folder), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        seen[name] = (before, after)
    before, after = seen["toxicity"]
    nasty = {i for i, t in before.items() if "nasty" in (t or "")}
    assert not nasty & after and set(before) - nasty == after
    before, after = seen["exact_dedup"]
    groups = collections.defaultdict(list)
    for i, t in before.items():
        groups[normal(t)].append((-len(t or ""), i))
    assert after == {min(g)[1] for g in groups.values()}
    before, after = seen["ngram_join"]
    sets = {i: set(shingles_of(t).tolist()) for i, t in before.items()}
    alike = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in before:
        near = [j for j in before if j != i and alike(i, j)]
        assert (i in after) == (not near or i < min(near))
    before, after = seen["decontamination"]
    assert set(before) - after == {i for i, t in before.items() if any(x in (t or "") for x in items.values())}
    encoder = Encoder(word_bpe())
    tokens = {r["doc_id"]: len(encoder.encode(r["text"])) // 4 + 1 for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] in after}
    found = collections.Counter()
    for r in docs.collect():
        found[r["doc_id"]] += r["length"]
    assert found == tokens


def test_run_and_queries(spark, corpus):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]
    assert sorted(int(k.split("_")[0][2:]) for k in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    rows = {r["doc_id"]: r for r in queries()["op10_suffix_array_dedup"](spark, folder).collect()}
    assert rows[900]["n_bytes"] == 0 and rows[900]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    scored = queries()["op4_toxicity"](spark, folder).collect()
    assert np.mean([r["predicted"] for r in scored]) < 0.4 and all((r["score"] >= tox.THRESHOLD) == bool(r["predicted"]) for r in scored)


def odd_rows():
    """Null ids, null, empty, blank and very long texts, repeated rows, ties, and columns of any type whose names clash."""
    random.seed(22)
    words = [f"v{n}" for n in range(300)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(12)]
    rows = [(n, t, "en") for n, t in enumerate(texts)]
    rows += [(None, texts[0], "en"), (None, None, None), (None, None, None), (20, None, "de"), (21, "", "de"), (22, " \t\n", None), (23, "!!!", "en")]
    rows += [rows[3], rows[3], (3, texts[3], "fr"), (24, texts[4] + " ", "en"), (25, texts[5], "en")]
    rows += [(30, "long " + " ".join(random.choices(words, k=150_000)), "en"), (31, "é" * 300_000, "en"), (32, "\0\x01\x1c odd ퟿ 😀", "en")]
    return [(i, t, lang, {"k": n % 2}, n % 3, "d", b"x", [1.5]) for n, (i, t, lang) in enumerate(rows)]


ODD = "doc_id long, text string, lang string, meta map<string,int>, score int, digest string, `class` binary, points array<double>"


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, tmp_path, stage):
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "v1 v2 v3 v4 v5 v6 v7 and nothing of it"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    name, run = corpus_pipeline.STAGES[stage]
    found = corpus_pipeline.table(run(spark, docs, folder), name)
    got = found.collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    if name != "packing":
        assert found.columns == docs.columns and not ids - collections.Counter(r[0] for r in rows)
    if name == "exact_dedup":
        # of 16 different texts (blank ones are equal) one each: 3 of four repeated rows, 4's longer copy, 5 before 25
        assert len(got) == len({normal(t) for _, t, *_ in rows}) and ids[3] == 1 and ids[24] == 1 and ids[4] == 0 and ids[5] == 1 and ids[20] == 0 and ids[22] == 1
    if name == "ngram_join":
        # texts without words link to none but equal ones (null is empty); repeated rows stand together
        assert ids[3] == 4 and ids[25] == 0 and ids[5] == 1 and {20, 22, 23} <= set(ids) and ids[21] == 0
    if name == "decontamination":
        assert len(got) == len(rows)
    if name == "packing":
        assert sum(r["start"] == 0 for r in got) == len(rows) and max(r["offset"] + r["length"] for r in got) <= 2048
    # no rows
    none = run(spark, docs.filter(F.lit(False)), folder)
    assert none.count() == 0


def test_stages_without_labels_and_benchmark(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(odd_rows(), ODD)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        assert stages[name](spark, docs, folder).count() == docs.count()
