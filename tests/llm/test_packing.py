import random

from lodestone.llm import packing as P


LENGTHS = (16, 24, 32, 48, 64)


def brute(sizes, lengths, overhead):
    """Best fit by looking at every bin, and the opened length by filling a bin of each with a plain list."""
    bins, out = [], []
    for k, s in enumerate(sizes):
        fit = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= s]
        if fit:
            room = min(fit)[0]
            i = max((k for r, k in fit if r == room), key=lambda k: bins[k][2])
        else:
            prices = []
            for c in lengths:
                if c >= s:
                    fill = s
                    for x in sizes[k + 1 :]:
                        fill += x if fill + x <= c else 0
                    prices.append(((min(q for q in lengths if q >= fill) + overhead) / fill, c))
            bins.append([min(prices)[1], 0, 0])
            i = len(bins) - 1
        bins[i][1] += s
        bins[i][2] = len(out)
        out.append(i)
    return out


def cost(final, overhead):
    return sum(c + overhead for c in final)


def least_cost(sizes, lengths, overhead):
    """By trying every way to put the sizes into bins."""
    best = float("inf")

    def put(k, loads):
        nonlocal best
        if k == len(sizes):
            best = min(best, cost((min(c for c in lengths if c >= x) for x in loads), overhead))
            return
        for i in range(len(loads)):
            if loads[i] + sizes[k] <= max(lengths):
                put(k + 1, [*loads[:i], loads[i] + sizes[k], *loads[i + 1 :]])
        put(k + 1, [*loads, sizes[k]])

    put(0, [])
    return best


def test_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 120))), reverse=True)
        bins, offsets, final = P.packed_sizes(sizes, LENGTHS, 2)
        assert bins == brute(sizes, LENGTHS, 2)
        for b, length in enumerate(final):
            used = sum(s for s, x in zip(sizes, bins, strict=True) if x == b)
            assert used <= length and not any(used <= c < length for c in LENGTHS)


def test_near_the_least_cost():
    rng = random.Random(3)
    ratios = []
    for _ in range(60):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 7))), reverse=True)
        ratios.append(cost(P.best_packing(sizes, LENGTHS, 2)[2], 2) / least_cost(sizes, LENGTHS, 2))
    assert max(ratios) <= 1.3 and sum(ratios) / len(ratios) <= 1.02


def test_several_lengths_pay():
    rng = random.Random(4)
    sizes = sorted((rng.choice([rng.randint(700, 768), rng.randint(1300, 1500), rng.randint(20, 250)]) for _ in range(2000)), reverse=True)
    joint, top = cost(P.best_packing(sizes, P.LENGTHS)[2], P.OVERHEAD), max(P.LENGTHS)
    assert joint < 0.95 * cost([top] * len(P.packed_sizes(sizes, (top,))[2]), P.OVERHEAD)
    for one in P.LENGTHS:
        assert joint <= cost(P.packed_sizes(sizes, P.LENGTHS, one=one)[2], P.OVERHEAD)
    assert len(set(P.packed_sizes(sizes, P.LENGTHS)[2])) >= 2


def test_equal_rows_spread_over_shards(spark):
    df = spark.range(30_000).selectExpr("cast(null as long) AS doc_id", "repeat('w ', 40) AS text")
    rows = P.packed(df).selectExpr("bin >> 32 AS shard").groupBy("shard").count().collect()
    assert len(rows) == 15 and max(r["count"] for r in rows) < 2300


def test_packed(documents, corpus, no_documents):
    rows = P.packed(documents, lengths=(64, 128, 256)).collect()
    sizes = sorted(len((t or "").split()) for _, t in corpus if (t or "").split())
    by_bin, total = {}, 0
    for r in rows:
        by_bin.setdefault(r["bin"], []).append(r)
        total += r["n_tokens"]
    assert total == sum(sizes)
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_tokens"]
        assert at <= b[0]["bin_length"]
    assert sum(b[0]["bin_length"] for b in by_bin.values()) <= 1.1 * total and len(rows) > 60
    assert P.packed(no_documents).collect() == []
