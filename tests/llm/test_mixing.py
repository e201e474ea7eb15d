import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing
from quire.llm.mixing import by_turns, mix, routed, sources, targets


def cheapest(words, quotas, most):
    """Most words and then least cost over all ways, for tiny networks of unit words."""
    units = [(p, r) for p, n in words.items() for _ in range(n) for r in range(most)]
    best = (0, 0)
    for way in itertools.product(*[[None, *p] for p, _ in units]):
        used = {s: way.count(s) for s in quotas}
        if all(used[s] <= q for s, q in quotas.items()):
            best = max(best, (sum(used.values()), -sum(r for (_, r), s in zip(units, way, strict=True) if s is not None)))
    return best


def test_flow_against_all_ways():
    r = random.Random(2)
    for _ in range(150):
        names = ["a", "b", "c"][: r.randint(1, 3)]
        patterns = {tuple(s for s in names if r.random() < 0.6) or (names[0],) for _ in range(3)}
        words = {p: r.randint(0, 2) for p in patterns}
        if sum(words.values()) > 3:
            continue
        quotas = {s: r.randint(0, 3) for s in names}
        flow = routed(words, quotas, 2)
        got = [sum(f.values()) for f in flow.routed]
        cost = sum(max(0, g - n) for g, n in zip(got, words.values(), strict=True))
        assert (sum(got), -cost) == cheapest(words, quotas, 2)
        assert all(g <= 2 * n for g, n in zip(got, words.values(), strict=True))
        assert all(sum(f.get(s, 0) for f in flow.routed) <= q for s, q in quotas.items()) and all(v >= 0 for f in flow.routed for v in f.values())


def test_flow_repeats_only_where_it_must():
    # source a can be filled by unseen words that b shares, since b has others
    flow = routed({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}, 2)
    assert [sum(f.values()) for f in flow.routed] == [10, 10, 10]
    dear = routed({("a",): 10, ("b",): 10}, {"a": 15, "b": 20}, 3, lambda p, n: n * n)
    assert [sum(f.values()) for f in dear.routed] == [15, 20]
    with pytest.raises(ValueError):
        routed({("a",): 1}, {"a": 1}, 2, lambda p, n: -n)


def test_targets():
    assert targets({"a": 100, "b": 100}, {"a": 3, "b": 1}) == {"a": 200.0, "b": 100.0}
    got = targets({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 1, "c": 2})
    assert got["a"] == 20 and got["b"] == 200 and got["c"] == 1.5 * 1110 - 220
    assert targets({"a": 0}, {"a": 1}) == {"a": 0.0} and targets({}, {}) == {}
    assert by_turns([None, "b", "a", "Z"]) == {"Z": 3, "a": 1, "b": 2, None: 3}


def frame(spark, rows, kind="string"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"doc_id long, text string, source {kind}, size string, taken int").repartition(5)


def test_each_source_is_taken_to_its_target(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 400)), r.choice(["a", "b", "c", None])) for i in range(600)] + [(None, "null id", "a"), (1, "same id again", "b"), (9000, None, "b"), (9001, "", "c"), (9002, "w " * 50_000, "c")]
    df = frame(spark, rows)
    out, plan = mix(df)
    assert out.columns == ["doc_id", "pattern", "size", "passes", "part", "taken"] and out.count() == len(rows)
    for s, t in plan.targets.items():
        some = [x for x in out.collect() if x["pattern"] == ('["' + s + '"]' if s else "[null]")]
        assert abs(sum(x["taken"] for x in some) - t) <= 0.5 and all(0 <= x["taken"] <= 2 * x["size"] for x in some)
        assert sum(0 < x["part"] < x["size"] for x in some) <= 1  # one document at most is taken in part
    key = lambda d: sorted(map(str, mix(d)[0].collect()))
    assert key(df) == key(df.repartition(2)) != key_of_seed(df, 5)
    assert {x["source"]: x["routed"] for x in sources(plan, df).collect()} == {s: int(t + 0.5) for s, t in plan.targets.items()}


def key_of_seed(df, seed):
    return sorted(map(str, mix(df, seed=seed)[0].collect()))


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None, "b"]) for i in range(90)] + [(90, "w " * 10, []), (91, "w " * 10, None)]
    out, plan = mix(frame(spark, rows, "array<string>"), weights=lambda s: dict.fromkeys(s, 1))
    assert set(plan.words) == {'["a","b"]', '["a"]', '["b",null]', "[null]"} and plan.words["[null]"] == 20
    assert out.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 920, abs=2)
    assert all(x["taken"] <= 2 * x["size"] for x in out.collect())


def test_odd_tables(spark):
    df = frame(spark, [(1, None, "a"), (2, "", None)])
    out, plan = mix(df)
    assert sorted((x["doc_id"], x["taken"]) for x in out.collect()) == [(1, 0), (2, 0)] and set(plan.targets.values()) == {0.0}
    out, plan = mix(df.filter("false"))
    assert out.count() == 0 and not plan.targets
    many = [(i % 2, "w", "a") for i in range(100)]  # two ids in all
    out, _ = mix(frame(spark, many))
    assert sum(x["taken"] for x in out.collect()) == 150
    named = df.withColumnRenamed("doc_id", "part")
    assert mix(named, "part")[0].columns == ["part", "pattern", "size", "passes", "_part", "taken"]


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 3)
    with pytest.raises(ValueError, match="patterns"):
        mix(frame(spark, [(i, "w", str(i)) for i in range(4)]))
