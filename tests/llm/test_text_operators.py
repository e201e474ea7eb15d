import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity as tox
from quire.llm.decontam import contaminated, drop_contaminated, edit_match, masks_of, match_start, pieces_of, plain, skipped_items, windows
from quire.llm.license_scan import BASE, BRIDGE, SHORTEST, TEMPLATES, Scanner, SuffixAutomaton, _best_chains, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_base(text):
    words = WORD.findall(low(text))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSED = [
    "Released under the MIT License.", "the mit\nLICENSE, mit-license mit licence", None, "", "...", "CC BY 4.0 cc. by, ÇC BY cc_by", "É gnu GENERAL public license apache license",
    TEMPLATES[2][1] + " and more", "x " * 50 + TEMPLATES[4][1], "Permission is hereby granted, free of charge, to any person",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list",
] * 2


def test_license_base_and_labels(spark):
    df = spark.createDataFrame([(n, t, "q") for n, t in enumerate(LICENSED)], "doc_id long, text string, labels string")
    found = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for n, text in enumerate(LICENSED):
        r = found[n]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text), text
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert "mit" in found[7]["labels"] and found[7]["score"] == 1.0 and found[9]["labels"] == ""
    assert scan_licenses(df.filter(F.lit(False))).count() == 0


def test_relatives_have_their_own_labels():
    scanner = Scanner(TEMPLATES, BASE)
    assert len(TEMPLATES) > 70 and len({label for label, _ in TEMPLATES}) > 18
    for label, text in TEMPLATES:
        r = scanner.scan(f"Some words stand before. {text} And some more behind.")
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(r["labels"].split(",")) == base | {label} and r["score"] == 1.0, (label, text)
    for text, labels in (
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
        ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),  # the first by its phrase
        ("Permission is hereby granted, free of charge, to any person", ""),
        ("this work is about the general public and its license", ""),
        ("See the GNU Lesser General Public License version 3 for details", "lgpl"),
        ("under the Mozilla Public License 2.0, the BSD 3-Clause License", "bsd-3-clause,mpl"),
        ("# SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"),  # the first by its phrase
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "agpl"),
        ("the identifier of a license clause, 3 of 2", ""),
    ):
        assert scanner.scan(text)["labels"] == labels, text
    # an edited notice: some words put in and left out
    notice = next(t for label, t in TEMPLATES if label == "agpl" and len(t) > 200).replace("it will be useful", "it is useful").replace("the Free Software", "the good old Free Software")
    r = scanner.scan(notice)
    assert set(r["labels"].split(",")) == {"agpl"} and 0.8 < r["score"] < 1


def test_chains_against_all_chains():
    random.seed(17)
    for _ in range(300):
        matches = []
        for _ in range(random.randint(1, 6)):
            first, t_first, n = random.randint(0, 40), random.randint(0, 30), random.randint(3, 8)
            matches.append((first, first + n - 1, t_first, t_first + n - 1))
        matches = sorted(set(matches), key=lambda m: (m[1], m[0]))

        def gain(chain):
            total = chain[0][1] - chain[0][0] + 1
            for p, m in zip(chain, chain[1:], strict=False):
                if p[1] >= m[1] or p[3] >= m[3] or m[0] - p[1] - 1 > BRIDGE:
                    return None
                total += min(m[1] - m[0] + 1, m[1] - p[1], m[3] - p[3]) - max(0, m[0] - p[1] - 1)
            return total

        every = [gain([m for k, m in enumerate(matches) if bits >> k & 1]) for bits in range(1, 1 << len(matches))]
        first, last, covered = _best_chains(matches, 40)[0]
        best = max(g for g in every if g is not None)
        assert covered - (last - first + 1 - covered) <= best <= covered


def test_suffix_automaton_against_search():
    random.seed(7)
    templates = [[random.randint(1, 4) for _ in range(25)] for _ in range(3)]
    automaton = SuffixAutomaton(templates)
    inside = lambda run: sorted((t, i + len(run) - 1) for t, x in enumerate(templates) for i in range(len(x) - len(run) + 1) if x[i : i + len(run)] == run)
    for _ in range(50):
        words = [random.randint(1, 5) for _ in range(40)]
        longest = [max(n for n in range(i + 2) if not n or inside(words[i + 1 - n : i + 1])) for i in range(len(words))]
        want = [(i, n, inside(words[i + 1 - n : i + 1])) for i, n in enumerate(longest) if n >= SHORTEST and (i + 1 == len(words) or longest[i + 1] <= n)]
        assert list(automaton.matches(words, 0)) == want


def test_long_license_text():
    assert Scanner(TEMPLATES, BASE).scan("the and " * 200_000 + "mit license")["n_base"] == 1


def least_edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edit_match_against_table():
    random.seed(8)
    for _ in range(300):
        a, b = "".join(random.choices("abc", k=random.randint(1, 12))), "".join(random.choices("abc", k=random.randint(0, 30)))
        masks = {}
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
        got, want = edit_match(a, masks, b, 4), least_edits(a, b)
        assert (got is None) == (want > 4) and (got is None or got[0] == want)


def test_match_start_against_table():
    random.seed(18)
    for _ in range(200):
        item = "".join(random.choices("abc", k=random.randint(8, 14)))
        part = list(item)
        for _ in range(random.randint(0, 2)):
            part[random.randrange(len(part))] = random.choice(["x", "", "yy"])
        text = "".join(random.choices("abc", k=9)) + "".join(part) + "".join(random.choices("abc", k=9))
        edits, end = edit_match(item, masks_of(item), text, 6)
        start = match_start(item, text, edits, end)
        distance = lambda x: least_edits_whole(item, x)
        assert distance(text[start:end]) == edits == min(distance(text[a:end]) for a in range(end + 1))


def least_edits_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_windows_hold_each_start_once():
    assert list(windows([], 3)) == [] and list(windows([5], 3)) == [(5, 5)]
    assert list(windows([0, 1, 3, 4, 7, 8, 20], 3)) == [(0, 3), (4, 7), (8, 8), (20, 20)]


def test_many_hits_of_a_common_piece(spark):
    """A text of one repeated piece, and a very long one: time grows with the hits."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "one two three four " * 30_000
    df = spark.createDataFrame([(1, text), (2, text + item), (None, item)], "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["edits"], r["last_char"] - r["first_char"]) for r in contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect())
    assert found == [(-1, 0, len(item)), (2, 0, len(item))]


def test_contamination_against_plain_version(spark):
    random.seed(9)
    words = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(400)]
    items = [(n, " ".join(random.choices(words, k=random.randint(12, 40)))) for n in range(12)] + [(50, "too short"), (51, None), (52, "")]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[random.randrange(len(text))] = random.choice("xyz ")
        return "".join(text)

    docs = [(n, " ".join(random.choices(words, k=60))) for n in range(20)]
    for n in range(40):
        item = random.choice(items[:12])[1]
        docs.append((100 + n, docs[n % 20][1] + "! " + edited(item.upper(), n % 9) + ", " + docs[(n + 3) % 20][1]))
    docs += [(300, None), (301, ""), (302, docs[-1][1]), (302, docs[-1][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, k) for i, t in docs for k, x in items if plain(x).count(" ") >= 4 and least_edits(plain(x), plain(t)) <= int(len(plain(x)) * 0.05))
    for block in (4_000_000, 500):
        assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(df, bench, block_chars=block).collect()) == want
        left = drop_contaminated(df, bench, block_chars=block)
        assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in docs if i not in {a for a, _ in want})
    assert contaminated(df, bench.filter("item_id < 0")).count() == 0 and contaminated(df.filter("doc_id < 0"), bench).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "水在标准大气压下的沸点是多少摄氏度？请选择正确的答案，并说明理由。"
    bench = spark.createDataFrame([(1, chinese), (2, "Forty two"), (3, "沸点"), (4, "..."), (5, None)], "item_id long, text string")
    docs = [(1, "前言：" + chinese + "完"), (2, "前言：" + chinese.replace("摄氏", "华氏") + "完"), (3, "It is forty-two."), (4, "forty twofold"), (5, "ordinary"), (6, "forty twofold, forty two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in contaminated(df, bench).collect())
    assert found == [(1, 1, 0), (1, 3, 0), (2, 1, 1), (2, 3, 0), (3, 2, 0), (6, 2, 0)]
    assert sorted(r["doc_id"] for r in drop_contaminated(df, bench).collect()) == [4, 5]
    assert sorted(r[0] for r in skipped_items(bench).collect()) == [4, 5]


def test_pieces_cover_the_item():
    budget, parts = pieces_of("x" * 233, 0.05)
    assert len(parts) == budget + 1 == 12 and "".join(p for _, p in parts) == "x" * 233


@pytest.fixture(scope="module")
def labelled_rows(spark):
    random.seed(10)
    words = [f"w{n}" for n in range(500)]
    rows = []
    for n in range(1200):
        text = random.choices(words, k=random.choice([5, 80, 400]))
        if n % 6 == 0:
            text[random.randrange(len(text))] = random.choice(["badone", "badtwo"])
        rows.append((n, " ".join(text), int(n % 6 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "w1 badone", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_toxicity_on_held_out_rows(spark, labelled_rows):
    rows, docs, labels = labelled_rows
    model = tox.fit(tox.labelled(docs, labels))
    scored = docs.select("doc_id", tox.held_out().alias("held_out"), tox.toxicity(model).alias("found")).collect()
    truth = {i: y for i, _, y in rows}
    test = [(r["found"] >= tox.THRESHOLD, truth[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in truth]
    right = sum(p == bool(y) for p, y in test) / len(test)
    assert len(scored) == len(rows) + 3 and len(test) > 200 and right > 0.98
    assert all(0 <= r["found"] <= 1 for r in scored)
    assert tox.labelled(docs, labels).count() == len(rows) + 3


def test_toxicity_without_labels(spark, labelled_rows):
    _, docs, labels = labelled_rows
    model = tox.fit(tox.labelled(docs, labels.filter("toxic = 0")))
    assert {r[0] for r in docs.select(tox.toxicity(model)).collect()} == {0.0}
    assert docs.filter("doc_id < 0").select(tox.toxicity(model)).count() == 0


def test_toxicity_counts_all_rows(spark):
    random.seed(11)
    words = [f"w{n}" for n in range(60)]
    train = [(1, " ".join(random.choices(words, k=8)) + f" badoneish x{n}" + " rareinsult" * (n % 70 == 0)) for n in range(2100)]
    train += [(0, " ".join(random.choices(words, k=9)) + f" x{n}") for n in range(300)]
    rest = [(None, f"{w} shared Shared") for w in words] + [(None, "one long " + "shared " * 50), (None, "")]
    df = spark.createDataFrame(train + rest, "label int, text string")
    ids = df.withColumn("doc_id", F.xxhash64("text"))
    labels = ids.filter("label is not null").select("doc_id", F.col("label").alias("toxic"))
    got = tox.labelled(ids, labels)
    assert got.count() == len(train + rest)
    assert got.filter("label is not null").count() == ids.filter("label is not null").filter(~tox.held_out()).count()
    twice, sizes = tox._different(df.unionAll(df))
    assert twice.filter("shared").count() == 2 * len(train + rest) and twice.filter("label is not null").count() == len(train) and sizes == {0: 300, 1: 2100}

    # the same in plain loops: texts that hold each word, contexts of words, texts of pairs
    labelled = [(y, t.lower().split()) for y, t in {(y, t) for y, t in train}]
    held, pairs = collections.Counter(), [collections.Counter(), collections.Counter()]
    for _, t in train + rest:
        held.update(set(t.lower().split()))
    for y, w in labelled:
        pairs[y].update(set(zip([""] + w, w, strict=False)))
    contexts = [collections.Counter(b for _, b in c) for c in pairs]
    types, tokens = [len(c) for c in pairs], [sum(c.values()) for c in pairs]
    usual = lambda c: min(max(c[1] / max(c[1] + 2 * c[2], 1), 0.1), 0.9)
    shared_d, pooled = usual(collections.Counter(held.values())), pairs[0] + pairs[1]
    pooled_d = usual(collections.Counter(pooled.values()))
    total = sum(held.values())
    model = tox.fit(df, sample=500)
    word_d = [model.level.word_discount[1] * types[y] / types[1] for y in (0, 1)]
    pair_d = [model.level.pair_discount[1] * tokens[y] / tokens[1] for y in (0, 1)]
    if types[0] < types[1]:
        word_d, pair_d = ([model.level.word_discount[0] * types[y] / types[0] for y in (0, 1)], [model.level.pair_discount[0] * tokens[y] / tokens[0] for y in (0, 1)])
    freed = [sum(min(n, word_d[y]) for n in contexts[y].values()) / types[y] for y in (0, 1)]

    def shared(word):
        return max(held[word] - shared_d, 0) / total + shared_d * len(held) / total / (len(held) + 1)

    def word_p(word, y):
        return max(contexts[y][word] - word_d[y], 0) / types[y] + freed[y] * shared(word)

    def ratio(a, b):
        p = [word_p(b, y) for y in (0, 1)]
        inner = [{k: n for k, n in pairs[y].items() if k[0] == a} for y in (0, 1)]
        sums = [sum(i.values()) for i in inner]
        left = [sum(min(n, pair_d[y]) for n in inner[y].values()) / sums[y] if sums[y] else 1 for y in (0, 1)]
        whole = max(sum(sums), 1)
        both = max(pooled[a, b] - pooled_d, 0) / whole + pooled_d * len(inner[0] | inner[1]) / whole * shared(b)
        tilt = [x / (sum(t * q for t, q in zip(tokens, p, strict=True)) / sum(tokens)) for x in p]
        q = [max(pairs[y][a, b] - pair_d[y], 0) / max(sums[y], 1) + left[y] * both * tilt[y] for y in (0, 1)]
        above = any(pairs[y][a, b] > pair_d[y] for y in (0, 1))
        return math.log(q[1] / q[0]) if above else math.log(p[1] / p[0]) + math.log(left[1] / left[0])

    some = [t for _, t in train[:6] + train[-6:] + rest[:6]] + ["unknown words", "w1", "rareinsult badoneish w3 w4"]
    for t in some:
        w = t.lower().split()
        want = [ratio(a, b) for a, b in zip([""] + w, w, strict=False)]
        assert np.allclose(model.ratios(tox.words_of(t)), want, atol=1e-9), t
    assert len(model.keys) > 3 and model.of_word[model.ids[b"badoneish"]] > 0.5
    assert tox.features(np.zeros(0)) == (0, 0) and model.score(None) == model.score("")

    # a model too large for the tasks gives the same scores by shuffles
    large = tox.fit(df, sample=500, most=30)
    assert large.tables is not None and len(large.ids) == 15
    odd = ids.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("found_scores")).limit(400).unionByName(spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (2, "badoneish " * 3000, 1, 2)], "doc_id long, text string, row int, found_scores int"))
    near = {(r["text"], round(r["score"], 9)) for r in tox.scored(odd, model).collect()}
    assert near == {(r["text"], round(r["score"], 9)) for r in tox.scored(odd, large).collect()} and tox.scored(odd, large).columns == [*odd.columns, "score"]
    with pytest.raises(ValueError):
        tox.toxicity(large)


def test_own_counts_are_left_out(spark):
    """The ratios that the curve is fitted on are near those of a model without the text (contexts that others share too count as its own)."""
    r = random.Random(7)
    texts = [(n % 3 == 0, " ".join(r.choices([f"w{k}" for k in range(300)], k=9)) + (" bad thing" if n % 3 == 0 else " good thing")) for n in range(120)]
    rows = [(int(y), t) for y, t in texts]
    df = lambda some: spark.createDataFrame(some, "label int, text string")
    model = tox.fit(df(rows), discounts=(2.0,))
    y, text = rows[0]
    without, without_own = model.ratios_without(tox.words_of(text), y), tox.fit(df(rows[1:]), discounts=(2.0,)).ratios(tox.words_of(text))
    assert np.abs(without - without_own).max() < 0.2 and abs(without[-2]) < abs(model.ratios(tox.words_of(text))[-2])


def test_bounded_labels_and_whole_shared_counts(spark):
    rows = [(int(n % 4 == 0), f"all u{n} {'bad' if n % 4 == 0 else 'good'}") for n in range(400)]
    df = spark.createDataFrame(rows, "label int, text string")
    assert tox._edges(df, {0: 300, 1: 100}, 100)[1] is None
    for bound in (50, 100):
        assert df.filter(tox._within(tox._edges(df, {0: 300, 1: 100}, bound))).groupBy("label").count().select("count").distinct().collect() == [(bound,)]
    model = tox.fit(df, labelled=50)
    assert abs(model.level.tokens - [150, 150]).max() == 0 and model.shared[model.ids[b"good"]] > 2 * model.shared[model.ids[b"bad"]]
    assert model.score("bad") > 0.5 > model.score("good")


def test_scripts_without_spaces_are_read_whole(spark):
    chars = [chr(0x4E00 + n) for n in range(80)]
    r = random.Random(5)
    rows = [(int(n % 4 == 0), "".join(r.choices(chars, k=300)) + ("\u4f60\u58de\u86cb" if n % 4 == 0 else "\u4f60\u597d\u55ce") + "".join(r.choices(chars, k=300))) for n in range(300)]
    assert len(tox.words_of(rows[0][1])) == 603 and tox.words_of("\u0e01\u0e02 Ab\u3042c") == [c.encode() for c in ("\u0e01", "\u0e02", "ab", "\u3042", "c")]
    model = tox.fit(spark.createDataFrame(rows[60:], "label int, text string"))
    assert np.mean([(model.score(t) >= tox.THRESHOLD) == bool(y) for y, t in rows[:60]]) > 0.95


def test_logistic_separates():
    y = np.array([0, 0, 0, 1, 1.0])
    x = np.array([[0, 0], [0.1, 0], [0, 0.2], [1, 1], [2, 0.5]])
    loss, (a, b, c), each = tox.logistic(y, x, np.ones(5))
    assert abs(each.mean() - loss) < 1e-3
    assert loss < 0.1 and all((a + b * p + c * q > 0) == bool(k) for k, (p, q) in zip(y, x, strict=True))
