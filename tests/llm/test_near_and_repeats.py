import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import ngram_join as near
from quire.llm.hashes import grams, word_shingles
from quire.llm.ngram_join import Forest, drop_near_copies, ngram_join, overlaps, prefix_depth, recall, shingles_of
from quire.llm.suffix_dedup import RunLengthIndex, anchors, least_in_windows, repeated_passages, without_periods


def near_rows():
    random.seed(11)
    words = [f"w{n}" for n in range(800)]
    rows = []
    for _ in range(25):
        base = random.choices(words, k=random.choice([3, 30, 120, 300]))
        for _ in range(random.choice([1, 2, 5])):
            text = list(base)
            for _ in range(random.choice([0, 1, 2, 6])):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((len(rows), " ".join(text)))
    hot = random.choices(words, k=150)
    for n in range(80):  # one large group of near copies, compared in blocks
        text = list(hot)
        text[n] = "new"
        rows.append((1000 + n, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, "!!!"), (2003, "..."), (2004, "!!!"), (2005, rows[0][1].upper()), (2006, rows[5][1]), (None, rows[7][1])]
    return rows


def check_near(rows, found, similarity=0.8):
    sets = [(i, frozenset(shingles_of(t).tolist()) or frozenset([("text", t or "")])) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    classes = collections.defaultdict(list)
    for i, s in sets:
        classes[s].append(i)
    parent = {s: s for s in classes}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = collections.defaultdict(set)
    for a in classes:
        for b in classes:
            if a != b and len(a & b) >= similarity * len(a | b):
                links[a].add(b)
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for s in classes:
        groups[root(s)] += classes[s]
    got = {(r["doc_id"], bytes(r["digest"])): r for r in found}
    for (i, t), (_, s) in zip(rows, sets, strict=True):
        r = got[(i, hashlib.sha256((t or "").encode()).digest())]
        assert r["class_id"] == min(classes[s], key=order) and r["class_size"] == len(classes[s])
        assert r["n_links"] == len(links[s]) and r["n_linked_docs"] == sum(len(classes[x]) for x in links[s])
        assert r["group_id"] == min(groups[root(s)], key=order)
    return len(groups)


def test_join_against_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    for block in (512, 16):
        found = ngram_join(df, block=block).collect()
        assert len(found) == len(rows)
        groups = check_near(rows, found)
    left = drop_near_copies(df)
    assert left.columns == df.columns and left.count() == groups
    assert ngram_join(df.filter(F.lit(False))).count() == 0


def test_depth_meets_target_at_each_similarity():
    assert prefix_depth(0.8) == 3
    for s in (0.8, 0.85, 0.9, 0.97):
        d = prefix_depth(s)
        assert recall(s, d) >= 0.9999 and (d == 8 or recall(s, d + 1) < 0.9999)
    assert prefix_depth(0.99) == 8


def test_forest_paths_share_prefixes_as_expected():
    rng = np.random.default_rng(3)
    forest, hits, n = Forest(16, 8), np.zeros(9), 300
    for _ in range(n):
        both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (90, 5, 5))  # 90 of 100
        x, y = (np.frombuffer(forest.paths(np.concatenate([both, own])), ">u4").reshape(16, 8) for own in (a, b))
        same = np.cumprod(x == y, axis=1).sum(axis=1)
        hits += [(same >= d).any() for d in range(9)]
    for d in range(1, 9):
        assert abs(hits[d] / n - recall(0.9, d)) < 0.03


def test_unrelated_rows_take_no_link_away(spark):
    """Single pairs of a similarity of 0.80 to 0.82 that share no whole path, beside a family of 200 near copies."""
    r = random.Random(21)
    words = [f"w{n}" for n in range(20_000)]
    pairs, forest = [], Forest(16, 8)
    while len(pairs) < 12:
        base = r.choices(words, k=240)
        other = base[:215] + r.choices(words, k=25)
        a, b = (shingles_of(" ".join(t)) for t in (base, other))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        paths = [np.frombuffer(forest.paths(x), ">u4").reshape(16, 8) for x in (a, b)]
        if 0.8 <= similarity <= 0.82 and not (paths[0] == paths[1]).all(axis=1).any():
            pairs.append((" ".join(base), " ".join(other)))
    rows = [(2 * n + k, t) for n, p in enumerate(pairs) for k, t in enumerate(p)]
    base = r.choices(words, k=600)
    family = [(1000 + n, " ".join([f"a{n}", *base] if n % 2 else [*base, f"b{n}"])) for n in range(200)]
    found = {x["doc_id"]: (x["group_id"], x["n_links"]) for x in ngram_join(spark.createDataFrame(rows + family, "doc_id long, text string")).collect()}
    assert all(found[i] == (i - i % 2, 1) for i, _ in rows)
    assert all(found[i] == (1000, 199) for i, _ in family)


def test_very_long_text_and_a_script_without_spaces(spark):
    long = " ".join(f"w{n}" for n in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "\u6f22\u5b57" * 300), (4, "\u6f22\u5b57" * 300 + "\u6587"), (5, "\u6f22\u5b57" * 300)]
    found = {x["doc_id"]: (x["class_id"], x["group_id"], x["n_links"]) for x in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 1, 1), 2: (2, 1, 1), 3: (3, 3, 0), 4: (4, 4, 0), 5: (3, 3, 0)}


def test_overlaps_both_ways():
    random.seed(12)
    sets = [np.unique(np.array(random.choices(range(60), k=20), np.uint64)) for _ in range(30)]
    left, right = np.arange(10), np.arange(10, 30)
    for share in (0.05, 1.0):
        wanted = np.random.default_rng(1).random((10, 20)) < share
        got = overlaps(sets, left, right, wanted)
        assert all(got[i, j] == (len(set(sets[i]) & set(sets[10 + j])) if wanted[i, j] else 0) for i in range(10) for j in range(20))


def test_shingles():
    assert len(word_shingles([b"a", b"b"], 5)) == 1 and len(word_shingles([], 5)) == 0
    assert set(word_shingles(b"a b c d e f".split(), 5)) & set(word_shingles(b"x a b c d e".split(), 5))


def test_least_in_windows():
    x = np.random.default_rng(2).integers(0, 50, 97).astype(np.uint64)
    for size in (1, 2, 7, 97):
        assert least_in_windows(x, size).tolist() == [min(x[i : i + size]) for i in range(98 - size)]


def test_each_passage_holds_an_anchor():
    random.seed(13)
    data = np.frombuffer(bytes(random.choices(b"ab", k=700)), np.uint8)
    at, _ = anchors(data, 40, 20)
    hashes = grams(data, 20)
    for p in range(700 - 39):
        inside = [q for q in at if p <= q <= p + 20]
        assert min(hashes[q] for q in inside) == min(hashes[p : p + 21])


def test_periods_keep_few_anchors():
    for unit in (b"a", b"abc", b"0123456789" * 4):
        data = np.frombuffer(unit * (1_000_000 // len(unit)), np.uint8)
        at, found = anchors(data, 200, 100)
        keep, spans = without_periods(at, found, 200, 100)
        assert keep.sum() <= 400 and len(spans) == 1 and spans[0][1] - spans[0][0] >= len(data) - 2 * len(unit)


def test_run_length_index_against_search():
    random.seed(14)
    length, size = 12, 4
    for _ in range(20):
        groups, contexts, lefts = [], [], []
        for g in range(4):
            for _ in range(random.choice([1, 2, 9])):
                left, right = random.randint(0, length - size), random.randint(0, length - size)
                contexts.append(bytes(random.choices(b"aab\0", k=left)) + b"a" * size + bytes(random.choices(b"aab\0", k=right)))
                groups.append(g)
                lefts.append(left)
        order = random.sample(range(len(groups)), len(groups))
        groups, contexts, lefts = ([x[k] for k in order] for x in (groups, contexts, lefts))
        index = RunLengthIndex(np.array(groups), contexts, np.array(lefts), length, size)
        first, last = index.repeated()
        assert 0 < index.runs <= len(groups) * (2 * length - size)
        passage = lambda r, k: contexts[r][lefts[r] + k - (length - size) :][:length] if lefts[r] + k >= length - size else b""
        for r in range(len(groups)):
            starts = [k for k in range(length - size + 1) if len(passage(r, k)) == length and any(passage(o, k) == passage(r, k) for o in range(len(groups)) if o != r and groups[o] == groups[r])]
            assert (first[r], last[r]) == ((starts[0], starts[-1]) if starts else (-1, -1))


def repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows():
    random.seed(15)
    text = lambda k: "".join(random.choices("abcdé ", k=k))
    shared = [text(260), text(230), text(199), text(600)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "short"), (4, "z" * 700), (5, "ab" * 400), (6, text(250)), (7, "z" * 230), (8, text(90) + "zyx" * 900 + text(90)), (9, "q" + "yxz" * 200)]
    for n in range(60):
        parts = [text(random.randint(0, 150))]
        for _ in range(random.randint(0, 3)):
            parts += [random.choice(shared), text(random.randint(0, 90))]
        rows.append((10 + n, "".join(parts)))
    rows += [(200, rows[10][1]), (201, rows[6][1]), (201, rows[6][1]), (202, "q" + rows[30][1]), (None, rows[12][1])]
    return rows


def test_repeats_against_search(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    want = sorted((str(i), *w) for (i, _), w in zip(rows, repeats(rows, 200), strict=True))
    # small: several indexes, anchors counted apart and settled by digests, texts shuffled
    for options in ({}, {"most": 3, "together": 10, "support": 0.01}, {"support": 0.3, "broadcast": 0}):
        found = repeated_passages(df, **options).collect()
        got = sorted((str(r["doc_id"]), r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in found)
        assert got == want
    assert repeated_passages(df.filter(F.lit(False))).count() == 0


def test_very_long_texts_repeat_within(spark):
    """A megabyte of one letter, of one unit between other text, and a long text without repeats."""
    random.seed(16)
    plain = "".join(random.choices("abcdefgh", k=400_000))
    rows = [(1, "q" * 1_000_000), (2, "x" * 150 + "0123456789" * 50_000 + "y" * 150), (3, plain), (None, "y" + plain[1000:1500] + "z")]
    found = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {i: [(s["a"], s["b"]) for s in r["spans"]] for i, r in found.items()}
    assert spans == {1: [(0, 1_000_000)], 2: [(150, 500_150)], 3: [(1000, 1500)], None: [(1, 501)]}
