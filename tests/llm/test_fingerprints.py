"""Fingerprints against a plain Python version of the same samples, and against exact generalised Jaccard similarity."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest

pytest.importorskip("dredgeline.llm")
xxhash = pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from dredgeline.llm import fingerprints as fp  # noqa: E402

SCHEMA = "doc_id long, text string, source string, same int, ord string, `none` int, `a.b` int, `next` int, `x` int, `range` int"


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["é", "\U0001f600x", "中文", "b"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 90)))) for i in range(40)]
    rows += [(50 + i, rows[3][1]) for i in range(4)] + [(60, ""), (61, None), (62, " \n\t"), (63, "solo"), (64, "the " * 3000), (65, " ".join(r.choice(vocab) for _ in range(20_000)))]
    rows += [rows[7], rows[7], (8, "another text of eight"), (None, "no id"), (None, "no id"), (None, None), (-5, "negative id \U0001f600\U0001f600")]
    r.shuffle(rows)
    return rows


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def hash_long(v, seed=42):
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed % 2**64))


def hash_int(v, seed):
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", v), seed % 2**64))


def bits(h, first, count):
    return ((h % 2**64) >> first & (2**count - 1)) + 0.5


def brute_signature(text, samples):
    counts = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    if not counts:
        return None
    out = []
    for k in range(samples):
        best = None
        for word, n in counts.items():
            h = hash_int(k, hash_long_of(word))
            g = hash_long(h)
            r = 44 * math.log(2) - math.log(bits(h, 0, 22) * bits(h, 42, 22))
            c = math.log(62 * math.log(2) - math.log(bits(g, 0, 31) * bits(g, 31, 31)))
            b = bits(h, 22, 20) * 2.0**-20
            t = math.floor(math.log(n) / r + b)
            v = (math.floor((c - r * (t - b + 1) + 128) * 2**24) << 31) + ((h % 2**64) >> 33 ^ t)
            best = v if best is None else min(best, v)
        out.append(best)
    return out


def hash_long_of(word):
    """Spark hashes a column after the other, with the hash so far as the seed."""
    return hash_long(signed(xxhash.xxh64_intdigest(word.encode(), 42)))


def brute(rows, samples):
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], hashlib.sha256((r[1] or "").encode()).digest()))
    texts = [r[1] or "" for r in order]
    out = []
    for k, (i, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, e, x = (brute_signature(y, samples) for y in (t, edited, n))

        def near(p, q):
            return sum(u == v for u, v in zip(p, q)) / samples if p and q else float(p is None and q is None)

        def name(s):
            return "".join(f"{v & (2**31 - 1):08x}" for v in s or [])

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), name(a), name(e), near(a, e), near(a, x)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "o", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def test_fingerprints(spark):
    rows = corpus()
    got = fp.fingerprints(frame(spark, rows), samples=6)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got, want = sorted(map(tuple, got.collect()), key=repr), sorted(brute(rows, 6), key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert got == want
    assert fp.fingerprints(frame(spark, [])).count() == 0
    (one,) = fp.fingerprints(frame(spark, [(1, "a b c")]), samples=4).collect()
    assert one.near_next == 1.0 and one.n_chars == 5


def test_equal_samples_estimate_generalised_jaccard(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(60) for _ in range(r.choice((1, 1, 2, 5)))]
    texts, n = [" ".join(base)], 4000
    for cut in (0.1, 0.4, 0.8):
        texts.append(" ".join([w for w in base if r.random() > cut] + [f"x{r.randrange(20)}" for _ in range(int(len(base) * cut))]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", fp.weighted_terms(F.col("t")).alias("terms"))
    sig = {i: brute_signature(t, 400) for i, t in enumerate(texts)}
    got = {x.id: list(x.s) for x in fp.signatures(df, ["id"], 24).collect()}
    assert got == {i: s[:24] for i, s in sig.items()}
    for i in (1, 2, 3):
        a, b = Counter(texts[0].split()), Counter(texts[i].split())
        exact = sum((a & b).values()) / sum((a | b).values())
        share = sum(p == q for p, q in zip(sig[0], sig[i])) / 400
        assert abs(share - exact) < 4 * math.sqrt(exact * (1 - exact) / 400)
