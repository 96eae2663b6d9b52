"""Vector codes against a plain Python version of the rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("dredgeline.llm")

from dredgeline.llm import vector_codes as vc  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, `a.b` int, code string, of int"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    out, kept = [], {}
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(len(v), []).append((i, [max(-(2**62), min(2**62, math.floor(x * scale))) for x in v], label))
    for d, own in kept.items():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [(d * p // parts, d * (p + 1) // parts) for p in range(parts)]
        books = [[r[1][a:b] for r in own[:entries]] for a, b in cuts]

        def assign(v):
            found = []
            for (a, b), book in zip(cuts, books):
                dist = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
                found.append((dist.index(min(dist)), min(dist)))
            return found

        for _ in range(rounds):
            codes = [assign(r[1]) for r in own]
            for p, (a, b) in enumerate(cuts):
                for e in range(len(books[p])):
                    mine = [r[1][a:b] for r, c in zip(own, codes) if c[p][0] == e]
                    if mine:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in own:
            c = assign(v)
            out.append([i, "".join(f"{x:02x}" for x, _ in c), min(sum(x for _, x in c), 2**63 - 1), label, sha])
    total: dict = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(i, c, e, min(total[lab], 2**63 - 1), s) for i, c, e, lab, s in out]


def check(spark, rows, **opts):
    df = spark.createDataFrame([(i, v, lab, 1, 2, "c", 3) for i, v, lab in rows], SCHEMA).repartition(3)
    got = vc.compress(df, **opts)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, **opts), key=repr)


def test_compress(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], r.choice((0, 1, 1, None))) for i in range(120)]
    rows += [(7, rows[3][1], 0), (7, rows[9][1], None), (None, rows[5][1], 1), (None, None, 1), (200, None, 2), (201, [1.0] * 15 + [None], 2), (202, [float("nan")] * 16, 2), (203, [float("inf")] * 16, 2)]
    rows += [(300 + i, rows[0][1], 3) for i in range(20)]  # a group of copies
    rows += [(400 + i, [r.gauss(0, 1) for _ in range(5)], 4) for i in range(6)] + [(500, [], 5)]  # other dimensions, fewer rows than entries
    check(spark, rows)
    check(spark, rows[:40], parts=4, entries=5, rounds=2, scale=10.0)


def test_large_components(spark):
    """Two limbs, Python integers, and what no long can hold."""
    r = random.Random(6)
    for size in (2.0**9, 2.0**16, 2.0**22, 2.0**45):
        check(spark, [(i, [r.uniform(-size, size) for _ in range(8)], i % 2) for i in range(40)], rounds=2)
    check(spark, [(i, [r.uniform(-1, 1) if i % 3 else r.choice((-1e300, 1e300, 1e19)) for _ in range(8)], 0) for i in range(40)], rounds=2)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vc.compress(empty).count() == 0 and vc.compress(empty).columns == COLUMNS


def test_limb_products_are_exact():
    r = np.random.default_rng(3)
    for width in (1, 8, 200):
        bits = vc.limb_bits(width)
        assert width * (1 << 2 * bits) <= 1 << 53
        for top in (1 << 10, 1 << 26, 1 << 40):
            x, y = r.integers(-top, top, (30, width)), r.integers(-top, top, (5, width))
            exact = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]
            assert all((int(g) - e) % 2**64 == 0 for row, want in zip(vc.products(x, y, bits), exact) for g, e in zip(row, want))
            assert (sum(z.astype(object) * (1 << bits * k) for k, z in enumerate(vc.limbs(x, bits))) == x.astype(object)).all()
