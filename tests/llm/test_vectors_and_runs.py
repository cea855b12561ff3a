import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from moltraj.llm import periodic_runs, top_products, whitening
from tests.llm import cases

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, x string, row string"


def vector_rows(count, dims, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(dims)] for _ in range(3)]
    return [(i, [float(np.float32(draw.gauss(c, 0.3))) for c in draw.choice(centres)]) for i in range(count)]


ODD = [
    (100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0]), (150, [float("inf"), 0.0]), (None, [1.0, 2.0]), (200, []), (250, [-0.5]),
    (7, [0.25, 0.25]), (7, [0.25, 0.25]), (50, [1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (300, [0.0, -0.0]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], VECTORS)


def whole(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v))) for i, v in kept], dims


def brute_top(rows, modulus, k):
    kept, _ = whole([row for row in rows if row[0] is not None])
    found = []
    for at, (i, x) in enumerate(kept):
        if i % modulus == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for other, (j, y) in enumerate(kept) if other != at)
            found += [(i, place + 1, j, -s) for place, (s, j) in enumerate(scored[:k])]
    return Counter(found)


@pytest.mark.parametrize("rows, options", [
    (ODD, {}),
    (vector_rows(400, 8, 1) + ODD, {"seeds": 3, "shard": 40, "block": 4}),
    (vector_rows(300, 70, 2), {"seeds": 16, "shard": 64}),
    ([(i, [1.0, 0.5]) for i in range(120)], {"seeds": 2, "shard": 10}),
    ([(i, [3e4 * (i + 1), -2e4, 1.0]) for i in range(60)], {"seeds": 5}),
    ([(0, [1.0])], {}), ([(50, [])], {}), ([(0, []), (1, [])], {}),
])
def test_top_products_against_brute_force(spark, rows, options):
    got = top_products.top_products(frame(spark, rows).repartition(3), F.col("id") % 10 == 0, 5, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(row) for row in got.collect()) == brute_top(rows, 10, 5)


def test_top_products_of_an_empty_table(spark):
    assert top_products.top_products(frame(spark, []), F.col("id") % 50 == 0).count() == 0
    assert top_products.top_products(frame(spark, ODD[:4]), F.col("id") % 50 == 0).count() == 0


def test_top_products_sql_on_small_rows(spark):
    rows = vector_rows(200, 6, 5) + [row for row in ODD if row[1] is None or len(row[1]) == 0]
    rows = [row for row in rows if row[1] != []] + [(100, vector_rows(1, 6, 9)[0][1])]
    connection = duckdb.connect()
    embeddings = frame(spark, rows).toArrow()  # noqa: F841
    connection.register("embeddings", embeddings)
    expected = connection.sql(top_products.ORACLE_SQL).fetchall()
    got = top_products.top_products(frame(spark, rows), F.col("id") % 50 == 0).collect()
    assert Counter(tuple(row) for row in got) == Counter(expected)


def test_bounds_prune_and_stay_exact():
    """Few pairs are multiplied where lengths and directions differ, and the result is that of all pairs."""
    draw = np.random.default_rng(3)
    x = (draw.normal(size=(3000, 32)) * np.exp(draw.normal(size=(3000, 1))) * np.linspace(60, 1, 32)).astype(np.int64)
    _, turn = np.linalg.eigh((x.T @ x).astype(float))
    held = top_products.Turned(x, np.ascontiguousarray(turn[:, ::-1]), 8)
    order = np.argsort(-held.length, kind="stable")
    candidates = top_products.Turned(x[order], np.ascontiguousarray(turn[:, ::-1]), 8)
    queries = top_products.Turned(x[:40], np.ascontiguousarray(turn[:, ::-1]), 8)
    best = top_products.search(queries, np.arange(40), np.full(40, -np.inf), candidates, order, order, 5)
    scores = x[:40] @ x.T
    for q in range(40):
        expected = sorted((-scores[q, j], j) for j in range(3000) if j != q)[:5]
        assert list(zip(-best.score[best.query == q], best.id[best.query == q])) == expected


def test_scores_that_do_not_fit_are_refused():
    big = top_products.Turned(np.full((2, 2), 1 << 40), np.eye(2), 1)
    with pytest.raises(OverflowError):
        top_products.exact_products(big, big, np.array([0]), np.array([1]))


# --- whitening -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, values", [
    (1, None), (2, None), (7, None), (64, None), (40, [3.0] * 40), (30, [5.0] * 10 + [2.0] * 10 + [1.0] * 10), (20, [4.0, 3.0] + [0.0] * 18),
    (32, [10.0**-i for i in range(32)]), (24, [1 + 1e-9 * i for i in range(24)]),
])
def test_components_against_eigh(size, values):
    draw = np.random.default_rng(size)
    q, _ = np.linalg.qr(draw.normal(size=(size, size)))
    a = q @ np.diag(values if values else draw.gamma(1.0, size=size)) @ q.T
    a = (a + a.T) / 2
    found, basis = whitening.spectral_components(a)
    top = np.abs(np.linalg.eigvalsh(a)).max()
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-13 * top
    assert np.abs(a @ basis - basis * found).max() < 1e-13 * top
    assert np.abs(basis.T @ basis - np.eye(size)).max() < 1e-13


def test_polar_factor_is_the_sign():
    draw = np.random.default_rng(0)
    q, _ = np.linalg.qr(draw.normal(size=(12, 12)))
    values = np.array([1.0, -1e-6, 3.0, -2.0, 1e-9, 5.0, -7.0, 0.1, -0.1, 2.0, -3.0, 1e-3])
    sign = q @ np.diag(np.sign(values)) @ q.T
    assert np.abs(whitening.polar_factor(q @ np.diag(values) @ q.T) - sign).max() < 1e-5


@pytest.mark.parametrize("rows", [
    vector_rows(300, 6, 4) + [row for row in ODD if not row[1] or None in row[1]], vector_rows(50, 3, 5) * 2, vector_rows(40, 2, 6, 1000.0),
    [(i, [float(i % 3), 1.0, 2.0]) for i in range(30)], vector_rows(200, 5, 8) + [(i, [0.5] * 5) for i in range(200, 300)],
])
def test_whitening_against_numpy(spark, rows):
    got = whitening.whitened(frame(spark, rows).repartition(3)).collect()
    kept, dims = whole(rows)
    x = np.array([v for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    count = int((values[:4] > 1e-10 * values.sum()).sum())
    w = (x - sums / n) @ basis[:, :count] / np.sqrt(values[:count])
    deviations = [sum(int(c) ** 2 for c in row) for row in n * x - sums]
    assert len(got) == len(kept) * count and {row["n"] for row in got} == {n}
    by_row = {}
    for row in got:
        by_row.setdefault(row["component"], []).append((row["vec_id"] is None, row["vec_id"] or 0, row["deviation"], round(abs(row["whitened"]), 8)))
        assert abs(row["explained"] - values[row["component"] - 1] / values.sum()) < 1e-10 and row["identity_error"] < 1e-10
    for component, found in by_row.items():
        expected = [(i is None, i or 0, d, round(abs(v), 8)) for (i, _), d, v in zip(kept, deviations, w[:, component - 1])]
        assert np.allclose([f[3] for f in sorted(found)], [e[3] for e in sorted(expected)], atol=1e-7)
        assert [f[:3] for f in sorted(found)] == [e[:3] for e in sorted(expected)]


def test_whitening_without_variance_or_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], ODD[:4], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]):
        got = whitening.whitened(frame(spark, rows))
        assert got.columns == columns and got.count() == 0


def test_deviations_beyond_a_long_are_null():
    assert whitening.exact_deviations(np.array([[3, 4], [1 << 31, 1 << 31], [1 << 32, 1 << 31]])) == [25, None, None]
    assert whitening.exact_deviations(np.array([[3_000_000_000, 0]])) == [9_000_000_000_000_000_000]


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(words, least):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            part = words[at : end + q]
            if end > at and len(part) >= max(least, 2 * q):
                smallest = next(r for r in range(1, q + 1) if all(part[k] == part[k + r] for k in range(len(part) - r)))
                if smallest == q:
                    found.add((at, len(part), q))
            at = end + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(400):
        words = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 8, 30])) for _ in range(draw.randint(0, 110))]
        for _ in range(draw.randint(0, 3)):
            if len(words) > 3:
                start, q = draw.randrange(len(words)), draw.randint(1, 14)
                for i in range(start + q, min(len(words), start + q * draw.randint(2, 5) + draw.randint(0, 5))):
                    words[i] = words[i - q]
        for least in (2, 7, 12):
            assert periodic_runs.runs_of(words, least) == brute_runs(words, least)


def test_very_periodic_and_very_long_texts():
    assert periodic_runs.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    assert periodic_runs.runs_of([b"%d" % (i % 9) for i in range(20_000)]) == [(0, 20_000, 9)]
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periodic_runs.runs_of(fibonacci[-1]) == brute_runs(fibonacci[-1], 12)


def expected_digest(text, ident, least=12):
    words = [w.encode() for w in cases.words(text)]
    h = zlib.crc32(str(ident).encode())
    if ident is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words, least)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    rest = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (ident, len(runs), *rest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("clashing", [False, True])
def test_run_digests_of_odd_rows(spark, clashing):
    rows = [row for row in cases.document_rows() if len(row[1] or "") < 5000] + [(i, cases.BODY + " " + cases.BODY, "en", "s", 1) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    docs = docs.withColumns({name: F.lit("own") for name in cases.CLASHES}) if clashing else docs
    got = Counter(tuple(row) for row in periodic_runs.digests(docs).collect())
    assert got == Counter(expected_digest(row[1], row[0]) for row in rows)
    assert periodic_runs.digests(cases.empty(spark)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 6 + "y"), (2, None), (3, "no run in here")], "doc_id bigint, text string")
    got = {row["doc_id"]: row for row in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(run) for run in got[1]["runs"]] == [(1, 18, 3)] and got[1]["collapsed"] == "x a b c y"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["n_words"] == 0
    assert got[3]["collapsed"] == "no run in here"
    assert periodic_runs.periodic_runs(cases.documents(spark, True)).count() == len(cases.document_rows())
