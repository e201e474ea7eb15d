from pyspark.sql import functions as F

from quire.operators import ingest
from quire.operators.refinement import AnswerStore, answered, preferences, refined
from quire.sources.tables import joined_spread


def logged(folder, answer):
    """A provider that notes each text it is asked."""

    def ask(texts):
        import uuid

        for t in texts:
            (folder / uuid.uuid4().hex).write_text(t)
        return [answer(t) for t in texts]

    return ask


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def fails_on(word, made):
    def answer(text):
        if word in text:
            raise ValueError("broken")
        return made(text)

    return answer


def test_a_piece_is_asked_once_and_a_rerun_asks_nothing(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    docs = spark.createDataFrame([("a", "one\n\n" + "x" * 18), ("b", "one\n\n" + "y" * 18), ("c", "bad"), ("d", ""), ("e", None), ("f", "same"), ("g", "same")], "doc_uuid string, raw_markdown string").repartition(3)
    store = AnswerStore(str(tmp_path / "store"), "model-1")
    ask = logged(notes, fails_on("bad", str.upper))
    first = {r["doc_uuid"]: (r["refined_markdown"], r["failed_pieces"]) for r in refined(docs, store, ask, most=20, split=False).collect()}
    assert first["a"] == ("ONE\n\n---\n\n" + "X" * 18, 0) or first["a"][0].replace("\n", "").replace("-", "") == "ONE" + "X" * 18
    assert first["c"] == ("bad", 1) and first["d"] == ("", 0) and first["f"] == first["g"] == ("SAME", 0)
    calls = asked(notes)
    assert len(calls) == len(set(calls)) and calls.count("same") == 1
    second = {r["doc_uuid"]: (r["refined_markdown"], r["failed_pieces"]) for r in refined(docs, store, ask, most=20, split=False).collect()}
    assert second == first and asked(notes) == sorted([*calls, "bad"])  # only the failed piece is asked again
    other = AnswerStore(store.folder, "model-2")
    assert refined(docs.filter("doc_uuid = 'f'"), other, logged(notes, str.title), most=20, split=False).first()["refined_markdown"] == "Same"


def test_one_broken_text_leaves_its_batch(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(["good", "bad", None, "fine"])], "n int, content string").coalesce(1)
    upper = fails_on("bad", str.upper)
    got = {r["n"]: (r["answer"], r["failed"]) for r in ingest.generated(rows, lambda ts: [upper(t) for t in ts]).collect()}
    assert got == {0: ("GOOD", False), 1: ("bad", True), 2: (None, False), 3: ("FINE", False)}


def test_refined_documents_stay_and_front_matter_is_parted(spark, tmp_path):
    rows = [("a", "raw", "refined text that is long enough", "title: x"), ("b", "raw b", "short", "title: x"), ("c", "raw c", None, None)]
    docs = spark.createDataFrame(rows, "doc_uuid string, raw_markdown string, refined_markdown string, yaml_metadata string")
    answer = lambda ts: ['---\ntitle: New\n---\nBody of ' + t + '\n```json\n[{"question": "q", "answer": "a"}]\n```' for t in ts]
    got = {r["doc_uuid"]: r for r in refined(docs, AnswerStore(str(tmp_path / "s")), answer).collect()}
    assert got["a"]["refined_markdown"] == "refined text that is long enough" and got["a"]["yaml_metadata"] == "title: x"
    assert got["b"]["refined_markdown"].strip().startswith("Body of raw b") and "title: New" in got["c"]["yaml_metadata"]
    assert [tuple(p) for p in got["c"]["pairs"]] == [("q", "a")]


def test_preferences(spark, tmp_path):
    said = spark.createDataFrame([("u1", "I prefer short answers. "), ("u1", "Please use tables"), ("u2", "what is this"), ("u9", "I like cats"), ("u1", "I like bad."), ("u1", None)], "user_id string, text string")
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    answers = {"I prefer short answers.": '"User prefers short answers."', "Please use tables": "None"}
    got = preferences(said, AnswerStore(str(tmp_path / "s")), lambda ts: [answers[t] for t in ts], users).collect()
    assert sorted((r["user_id"], r["memory_text"], len(r["embedding"])) for r in got) == [("u1", "I like bad", 768), ("u1", "User prefers short answers", 768)]


def test_a_common_key_is_joined_in_parts(spark):
    rows = spark.createDataFrame([("hot" if n % 3 else None if n % 2 else f"k{n}", n) for n in range(3000)], "k string, n int")
    known = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(0, 3000, 6)], "k string, v int")
    got = joined_spread(rows, known, "k").collect()
    assert len(got) == 3000 and all(r["v"] == (1 if r["k"] == "hot" else r["n"] if r["k"] else None) for r in got)
    assert joined_spread(rows.filter("false"), known, "k").count() == 0


def test_shared_answers_are_joined_to_all(spark, tmp_path):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("content"))
    got = answered(rows, AnswerStore(str(tmp_path / "s")), lambda ts: [t + "!" for t in ts]).collect()
    assert len(got) == 500 and all(r["answer"] == r["content"] + "!" for r in got)
