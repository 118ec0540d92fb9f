import numpy as np

from lodestone.llm import embedding_dedup as E


def brute(rows, threshold):
    ok = [(k, i, np.array(v, float), l) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = [(a, b) for a in ok for b in ok if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= threshold]
    part = {k: k for k in range(len(rows))}
    for a, b in near:
        old, new = part[a[0]], part[b[0]]
        part = {k: new if p == old else p for k, p in part.items()}
    return sorted(((i, sum(a[0] == k for a, _ in near), min((rows[q][0] for q in part if part[q] == part[k] and rows[q][0] is not None), default=None)) for k, (i, _, _) in enumerate(rows)), key=str)


def sample():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = rng.normal(size=64)
        center /= np.linalg.norm(center)
        for _ in range(12):
            v = center + rng.normal(size=64) * rng.choice([0.01, 0.017, 0.02])
            rows.append((len(rows), v.astype(np.float32).astype(float).tolist(), c % 3))
    rows += [(len(rows) + 0, rows[0][1], 0), (len(rows) + 1, rows[0][1], 1), (len(rows) + 2, [2 * x for x in rows[5][1]], 0)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [None] + [1.0] * 63, 1), (n + 3, [float("nan")] * 64, 1), (n + 4, rows[3][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1), (None, rows[3][1], 0)]


def test_links(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, id string").repartition(4)
    want = brute(rows, 0.98)
    for block, cell_rows in ((256, 20_000), (4, 3)):
        monkeypatch.setattr(E, "BLOCK", block)
        monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
        assert sorted((tuple(r) for r in E.linked(df).collect()), key=str) == want
    assert E.linked(df.limit(0)).collect() == []


def test_recall():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w
    hit = (E.cells(u, 0.98) == E.cells(v, 0.98)[:, :, :1]).any((1, 2))
    assert hit.mean() >= 0.999


def test_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    p = E.decode(x, 1)[:, 0] / 2
    assert ((p % 1 == 0).all(1) | ((p - 0.5) % 1 == 0).all(1)).all() and (p.sum(1) % 2 == 0).all()
    assert (np.linalg.norm(x - p, axis=1) <= 1 + 1e-9).all()


def test_equal_vectors_in_bulk(spark):
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    rows = [(i, v if i % 3 else w, 1) for i in range(1500)]
    found = {r["id"]: (r["n_links"], r["component"]) for r in E.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)).collect()}
    assert found == {i: (999, 1) if i % 3 else (499, 0) for i in range(1500)}


def test_signs_are_near_for_links():
    rng = np.random.default_rng(3)
    for d in (8, 64, 300):
        u = rng.normal(size=(2000, d))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(1)[:, None] * u
        w /= np.linalg.norm(w, axis=1)[:, None]
        apart = np.bitwise_count(E.signs(u).view(np.uint64) ^ E.signs(0.98 * u + np.sqrt(1 - 0.98**2) * w).view(np.uint64)).sum(1)
        assert (apart <= E.SIGNS).mean() >= 0.999
    assert E.most_signs(0.98) == E.SIGNS and E.most_signs(1.0) == 0
