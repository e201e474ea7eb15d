import random
import re
import zlib

from quire.llm import spelling
from quire.llm.spelling import key_of, runs, spelling_variants, variants, with_forms
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=5):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= times * n else None
        out[w] = [form, w, n, len(others), -best[0] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return out


def found(df):
    return {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in df.collect()}


def test_variants_against_all_pairs(spark):
    r = random.Random(3)
    for letters in ("ab", "abcé", "abcdefghijklmnopqrstuvwxyzÀß÷ÿ"):
        seeds = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(30)]
        words = set(seeds)
        for w in seeds * 4:
            i, kind = r.randrange(len(w)), r.randrange(4)
            c = r.choice(letters)
            words.add([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]][kind])
        counts = {w: r.choice([5, 5, 7, 30, 200, 6000]) for w in words}
        assert found(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_anagrams_are_not_near(spark):
    words = {"listen": 100, "silent": 5, "enlist": 7, "tinsel": 9}
    assert {v[3] for v in found(variants(spark.createDataFrame(list(words.items()), "word string, n long"))).values()} == {0}
    keys = {r["k"] for r in spark.createDataFrame([(w,) for w in words], "word string").select(key_of(F.col("word")).alias("k")).collect()}
    assert len(keys) == 1


def test_runs_of_whole_texts(spark):
    r = random.Random(4)
    words = ["Straße", "naïveté", "LETTERS", "Éclairs", "short", "a", "wonderful", "colours", "colors"]
    texts = [(i, " ".join(r.choice(words) + r.choice(["", "!", "1", "_x", "'s", "ÿ"]) for _ in range(300))) for i in range(40)] + [(None, "wonderful " * 9), (7, None), (8, ""), (9, "longest" * 20_000)]
    counts = {}
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                counts[word] = counts.get(word, 0) + 1
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    assert found(spelling_variants(df)) == plain({w: n for w, n in counts.items() if n >= 5})
    assert runs(df.filter("text is null")).count() == 0 and spelling_variants(df.filter("false")).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [("a" * n, 5 * 5 ** (12 - n)) for n in range(6, 13)]
    got = found(variants(spark.createDataFrame(chain, "word string, n long")))
    assert {v[1] for v in got.values()} == {"aaaaaa"} and got["a" * 12][0] == "a" * 11


def test_hot_neighbourhood_is_counted_whole(spark):
    alphabet = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xC0, 0x100)]
    words = [("qwert" + c, 5) for c in alphabet] + [("qwerty" + c, 5) for c in alphabet]
    got = found(variants(spark.createDataFrame(words, "word string, n long")))
    assert got == plain(dict(words)) and len(got) == 180


def test_texts_with_forms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Colour, colourr!"), (2, None), (3, ""), (4, "colourr")], "doc_id long, text string")
    told = spark.createDataFrame([("colourr", "colour", "colour"), ("colour", None, "colour")], "word string, form string, root string")
    want = {1: "The Colour, colour!", 2: None, 3: "", 4: "colour"}
    assert {r["doc_id"]: r["normalised"] for r in with_forms(docs, told).collect()} == want
    assert {r["doc_id"]: r["normalised"] for r in spelling._put_together(docs, told.filter("form is not null").select("word", "root"), "text", "normalised").collect()} == want
