"""The filter audit against a walk through every order, document by document."""

import re
from collections import Counter
from itertools import permutations

import pytest

pytest.importorskip("dredgeline.llm")

from dredgeline.llm import filter_audit as fa  # noqa: E402

DOCS = "doc_id long, text string, source string, part string, mask int, `a.b` int, n int"
LABELS = "doc_id long, quality int, toxic int"
MANY, FEW = " ".join(f"w{i}" for i in range(220)), "one two three"
ROWS = [
    (1, MANY, "x"), (2, MANY, "x"), (3, MANY, "y"), (3, MANY, "y"), (4, FEW, "x"), (5, FEW + " #", None), (6, FEW + " #", ""), (7, "a " * 300, "x"),
    (8, "ABC " * 80, "y"), (9, None, "y"), (10, "", "x"), (None, MANY, "x"), (None, "solo text", "y"), (None, "solo text", "y"), (11, "Aé\U0001f600 " * 201, "x"), (12, " \t\n ", "x"), (0, FEW, "y"),
] + [(20 + i, MANY + " $", "hot") for i in range(40)]
MARKS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (8, None, 1), (None, 1, 1), (25, 1, 0), (99, 1, 1)]


def brute(rows, marks):
    least, big = {}, 2**63 - 1
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", big), big if i is None else i)
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), (big if i is None else i) > least[t]), strict=True) if bad}
        docs.append((s or "", f, i in good, i in toxic))
    out, total = [], Counter()
    for part in sorted({d[0] for d in docs}):
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone: list = []
            for k, x in enumerate(order):
                now = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in gone)
                left = [d for d in left if x not in d[1]]
                gone += now
                total[part, x] += len(now)
                out.append([part, "".join(order), k + 1, len(left), len(now), redundant, sum(d[1] == {x} for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now), x])
    return [(*r[:-1], total[r[0], r[-1]]) for r in out]


def test_filter_audit(spark):
    docs = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in ROWS], DOCS)
    labels = spark.createDataFrame(MARKS, LABELS)
    got = sorted(map(tuple, fa.filter_audit(docs, labels).collect()))
    assert got == sorted(brute(ROWS, MARKS))
    assert sum(r[4] for r in got) > 1000 and fa.filter_audit(docs, labels.limit(0)).count() == len(got)
    assert fa.filter_audit(docs.limit(0), labels).count() == 0


def test_lattice_counts_orders():
    edges = fa.lattice("ABCDE")
    assert len(edges) == 80
    for k in range(5):  # every order takes one edge of each layer
        assert sum(p for s, _, p in edges if bin(s).count("1") == k) == 120
    with pytest.raises(ValueError):
        fa.lattice("AA")
    with pytest.raises(ValueError):
        fa.lattice("ABCDEFGH")


def test_other_filters(spark):
    """Two filters of the caller: shares add up to all removals."""
    cells = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 1, 3, 1, 0), ("p", 2, 2, 0, 0), ("p", 3, 4, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in fa.audit(cells, "XY").collect()}
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails) for k, r in got.items()} == {("XY", 1): (7, 7, 0, 3), ("XY", 2): (5, 2, 4, 2), ("YX", 1): (8, 6, 0, 2), ("YX", 2): (5, 3, 4, 3)}
    assert got["XY", 1].shapley + got["YX", 1].shapley == 2 * 9
