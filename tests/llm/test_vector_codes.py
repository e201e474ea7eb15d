import numpy as np
import pytest

from quire.llm.vector_codes import Moved, books_digest, compress, decoded, integers, reassigned, scan, with_label_errors


def plain(rows, parts, entries, rounds):
    """Full scans with Python's integers: codes, errors and codebooks of ``rows`` (id, integers)."""
    rows = sorted(rows)
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in set(own):
                members = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                books[p][k] = [sum(m[i] for m in members) // len(members) for i in range(width)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [bytes(k for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_against_full_scans(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(i), rng.integers(-spread, spread, 8).tolist()) for i in rng.permutation(300)]
    df = spark.createDataFrame([(i, [(x + 0.5) / 256 for x in v], i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    codes, books = compress(df, parts=4, entries=16, rounds=3)
    want_codes, want_errors, want_books = plain(rows, 4, 16, 3)
    got = sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in codes.collect())
    assert got == [(i, c, e) for i, (c, e) in enumerate(zip(want_codes, want_errors, strict=True))] and books.tolist() == want_books
    sums = {k: sum(want_errors[i] for i in range(300) if i % 3 == k) for k in range(3)}
    assert {r["label"]: r["label_error"] for r in with_label_errors(codes).collect()} == {str(k): n for k, n in sums.items()}


def test_bounds_spare_scans_but_never_ties():
    rng = np.random.default_rng(1)
    middles = rng.integers(-10_000, 10_000, (8, 4))
    x = middles[rng.integers(0, 8, 2000)] + rng.integers(-50, 50, (2000, 4))
    own, upper, lower = scan(x, middles)
    new = middles + rng.integers(-5, 5, middles.shape)
    got, up, low, scanned = reassigned(x, own, upper, lower, Moved.of(middles, new))
    want, want_up, want_low = scan(x, new)
    assert (got == want).all() and scanned < 20 and (up >= want_up - 1e-6).all() and (low <= want_low + 1e-6).all()
    # equal distances: an entry that moves into a tie must win by its lower number
    old, new = np.array([[9], [2]]), np.array([[-2], [2]])
    x = np.array([[0]])
    assert reassigned(x, *scan(x, old), Moved.of(old, new))[0].tolist() == [0]
    same = np.array([[1], [1], [5]])
    assert reassigned(x, *scan(x, same), Moved.of(same, same))[0].tolist() == [0]


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1e30, 1.0]), (None, [-0.001, 0.0]), (1, [0.5, 0.25]), (1, [0.1, 9.0])]
    df = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, code string, v string")
    codes, books = compress(df, parts=2, entries=3, rounds=1)
    got = sorted(((r["vec_id"], bytes(r["code"]), r["error"]) for r in codes.collect()), key=str)
    assert [g[0] for g in got] == [1, 1, 1, None] and got[1][1] == got[2][1] and books.shape == (2, 3, 1)
    assert integers(df, "vec_id", "embedding", "label", 2, 256)[0].filter("vec_id is null").first()["v"] == [-1, 0]  # floors go down
    assert {r["label_error"] for r in with_label_errors(codes).collect()} == {sum(g[2] for g in got)}
    none, books = compress(df.filter("vec_id = 2"), parts=2)
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error"] and books.size == 0 and len(books_digest(books)) == 64
    assert with_label_errors(none).count() == 0
    with pytest.raises(ValueError):
        compress(df, entries=257)


def test_many_labels_and_a_hot_one(spark, monkeypatch):
    from quire.llm import vector_codes

    monkeypatch.setattr(vector_codes, "LABELS", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else str(i) if i % 3 else None, b"", i) for i in range(2000)], "vec_id long, label string, code binary, error long")
    want = {}
    for r in rows.collect():
        want[r["label"]] = want.get(r["label"], 0) + r["error"]
    got = with_label_errors(rows).collect()
    assert len(got) == 2000 and all(r["label_error"] == want[r["label"]] for r in got)


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    codes, books = compress(df, parts=4, entries=64, rounds=4)
    back = np.array([r["embedding"] for r in decoded(codes, books).orderBy("vec_id").collect()])
    assert ((back - v) ** 2).sum() < 0.2 * (v**2).sum()
