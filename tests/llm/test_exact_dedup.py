import hashlib

import pytest
from pyspark.sql import functions as F


from quire.llm.common import shared_folder
from quire.llm.exact_dedup import drop_copies, exact_dedup

ROWS = [
    (1, "a b c", "x"), (2, "a  b\tc", "x"), (3, "abc", "y"), (4, None, "y"), (5, "", "z"), (6, " \n", "z"), (7, "other", "z"),
    (8, "A b c", "z"), (7, "other", "z"), (None, "lone", "n"), (9, "a\u00a0b c", "z"),
] + [(100 + n, "hot text", "h") for n in range(60)]
BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def test_against_plain_version(spark):
    groups = {}
    for doc_id, text, _ in ROWS:
        groups.setdefault((text or "").translate(BLANK), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = exact_dedup(frame(spark), support=0.1).collect()
    assert len(found) == len(ROWS)
    kept = {}
    for row in found:
        plain = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == row["text_sha256"])
        best = min(groups[plain])
        assert row["keep_id"] == best[3] and row["group_size"] == len(groups[plain])
        kept[plain] = kept.get(plain, 0) + row["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_drop_copies_keeps_columns_and_one_row_a_group(spark):
    left = drop_copies(frame(spark)).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 2, 6, 7, 8, 9, 100]
    assert left[0].__fields__ == ["doc_id", "text", "digest"]


def test_empty_table(spark):
    empty = frame(spark).filter(F.lit(False))
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


class Conf(dict):
    set = dict.__setitem__


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://x"])
def test_clusters_need_a_shared_folder(master):
    session = type("Session", (), {"conf": Conf({"spark.master": master})})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://x/shared/"
    assert shared_folder(session) == "hdfs://x/shared"


def test_columns_of_any_type_survive(spark):
    rows = [(1, "a b", {"k": 1}, None), (1, "a b", {"k": 1}, None), (1, "ab", {"k": 2}, "x"), (None, "ab", {}, "y"), (None, None, {}, "z"), (None, None, {"q": 3}, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, digest string")
    left = drop_copies(df)
    assert left.columns == df.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == [("1", "a b"), ("None", "")]
