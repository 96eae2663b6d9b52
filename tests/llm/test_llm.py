"""Edge cases and brute-force comparisons for the training-data operators."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("dredgeline.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from dredgeline.llm import bloom_lm, bpe, chat, huffman, jaccard_join, knn_quality, mixing, quality_rules, store, substring_dedup, token_files, topk  # noqa: E402
from dredgeline.llm import words as W  # noqa: E402
from dredgeline.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls, odd white space, one very long text."""
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["é,", "Ünï", "中文", "a b", "　", "x\x1cy", "<s>", "THE"]

    def text(n: int) -> list[str]:
        return [r.choice(vocab) for _ in range(n)]

    base, passage = text(300), text(70)
    rows = [(i, " ".join(text(r.randint(0, 120)))) for i in range(40)]
    rows += [(100 + i, " ".join(base)) for i in range(6)]
    for i in range(8):
        near = list(base)
        for _ in range(i):
            near[r.randrange(300)] = "edit"
        rows.append((120 + i, " \n".join(near) if i % 2 else "\t".join(near)))
    rows += [(140 + i, " ".join(text(30) + passage[i:] + text(20))) for i in range(8)]
    rows += [(160, " ".join(text(20_000))), (161, "the " * 500), (162, "b" * 9000), (163, "\n".join(["same line here"] * 60)), (164, "One two."), (165, "one TWO."), (166, " \n\t "), (167, ""), (168, None)]
    rows += [rows[41], rows[60], (None, "no id at all " * 30), (None, None)]
    out = [(i, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 5}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns under names that the operators use inside."""
    return spark.createDataFrame(corpus(), SCHEMA).selectExpr(
        "*", "1 AS did", "2 AS th", "'r' AS rest", "3 AS found", "4 AS lo", "5 AS size", "6 AS shard", "7 AS `key`", "8 AS fp", "9 AS `a.b`", "10 AS ids", "11 AS held_out", "12 AS epoch", "13 AS `__x`"
    )


def ws(text):
    return [] if text is None else text.encode().split()


def lower(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_words_match_bytes_split():
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()] + ["\x0b\x0c a", "z" * 200]
    data, off = W.utf8(pa.array(texts))
    first, end, row = W.spans(data, off)
    got = [bytes(data[a:b]) for a, b in zip(first, end)]
    assert [got[a:b] for a, b in zip(row[:-1], row[1:])] == [ws(t) for t in texts]
    h = W.hashes(data, first, end)
    assert len(set(h.tolist())) == len(set(got))
    keys = np.unique(h)
    table = W.Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    g = W.runs(h, 7)
    seen: dict = {}
    for i, x in enumerate(g.tolist()):
        assert seen.setdefault(x, got[i : i + 7]) == got[i : i + 7]


# ---- 1 -------------------------------------------------------------------------------------------
def brute_substring(rows, length=50):
    least: dict = {}
    big = 2**63 - 1
    for i, t, *_ in rows:
        w = ws(t)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            least[k] = min(least.get(k, big), big if i is None else i)
    out = []
    for i, t, *_ in rows:
        w = ws(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < (big if i is None else i):
                gone[p : p + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(docs, clashing, empty):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute_substring(corpus())
    assert sum(x[2] for x in want) > 2000
    same(substring_dedup.remove_repeats(docs).select(columns), want)
    same(substring_dedup.remove_repeats(clashing).select(columns), want)
    assert substring_dedup.remove_repeats(empty).count() == 0
    cut = substring_dedup.cut_repeats(clashing)
    assert cut.columns == clashing.columns
    same(cut.selectExpr("doc_id", "sha2(coalesce(array_join(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), ''), ' '), ''), 256)"), [(i, h) for i, _, _, h in want])
    same(cut.where("text IS NULL").select("doc_id"), [(i,) for i, t, *_ in corpus() if t is None])


def test_short_windows(docs):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(substring_dedup.remove_repeats(docs, 12, 5).select(columns), brute_substring(corpus(), 12))


# ---- 2 -------------------------------------------------------------------------------------------
def test_huffman_is_canonical_and_limited():
    r = np.random.default_rng(3)
    counts = (1e7 / np.arange(1, 3000) ** 1.6).astype(int)
    counts[5:9] = 0
    for limit in (12, 18):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths == 0) == (counts == 0)).all()
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
    code = huffman.Code(lengths)
    sizes = np.array([0, 1, 127, 128, 129, 5000])
    ids = r.choice(len(counts), size=sizes.sum(), p=counts / counts.sum())
    data, n_bytes, points = code.pack(ids, sizes)
    lanes = -(-sizes // huffman.EVERY)
    start = points + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, lanes)
    each = np.minimum(huffman.EVERY, np.repeat(sizes, lanes) - W.ragged(np.zeros(len(sizes), int), lanes) * huffman.EVERY)
    assert (code.unpack(data, start, each) == ids).all()
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


def test_token_files(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    path = f"{store.shared_dir(spark)}/test-token-files"
    token_files.write_token_files(docs, path, partial(token_files.library_pieces, JSON), 50_257)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    rows = corpus()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids in want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    token_files.write_token_files(empty, path + "-none", partial(token_files.library_pieces, JSON), 50_257)
    assert token_files.read_token_files(spark, path + "-none").count() == 0


# ---- 3 -------------------------------------------------------------------------------------------
def brute_quality(rows):
    def features(t):
        text = t or ""
        w = [x.decode() for x in ws(t)]
        lines = [x for x in text.split("\n") if ws(x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        covered = {p for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in text)

    want = []
    for i, t, *_ in rows:
        n, chars, sym, dup, rep, lines, cap = features(t)
        base = n < 50 or 100 * rep > 50 * n
        want.append((i, n, chars, sym, dup, rep, base, not (base or 10 * sym > n or 2 * dup > lines or 2 * cap > chars or not 2 * n <= chars <= 15 * n)))
    return want


def test_quality_rules(spark, docs, clashing, empty):
    want = brute_quality(corpus())
    same(quality_rules.judge(docs), want)
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns
    same(kept.select("doc_id"), [(x[0],) for x in want if x[-1]])
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0
    ordered = [m.worth for m in quality_rules.order_rules(docs, fraction=1.0)]
    assert ordered == sorted(ordered, reverse=True) and ordered[0] > 0


# ---- 4 -------------------------------------------------------------------------------------------
def rank_library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(docs, clashing, empty):
    library = rank_library()
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    same(got.selectExpr("doc_id", "ids", "CAST(decoded AS string)").rdd.map(lambda r: (r[0], tuple(r[1]), r[2])).toDF("doc_id long, ids array<int>, t string").selectExpr("doc_id", "array_join(CAST(ids AS array<string>), ',')", "t"),
         [(i, ",".join(map(str, library.encode_ordinary(t or ""))), t or "") for i, t, *_ in corpus()])
    back = bpe.decode(got.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    same(back.selectExpr("doc_id", "CAST(decoded AS string)"), [(i, t or "") for i, t, *_ in corpus()])
    wide = bpe.encode_rows(clashing.withColumnRenamed("did", "decoded"), RANKS, public_tokenizers.PATTERN)
    assert wide.columns == [*clashing.drop("ids", "did").columns, "ids", "decoded"]
    same(wide.selectExpr("doc_id", "size(ids)", "CAST(decoded AS string)"), [(i, len(library.encode_ordinary(t or "")), t or "") for i, t, *_ in corpus()])
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 5 -------------------------------------------------------------------------------------------
def test_quality_scores(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "a b"), (10**6 + 2, "x" * 50_000), (0, docs.where("doc_id = 0").first().text)], "doc_id long, text string")
    got = knn_quality.score_quality(docs.select("doc_id", "text").unionAll(odd).selectExpr("*", "1 AS score", "2 AS quality"), labels.selectExpr("*", "'x' AS text")).collect()
    assert len(got) == docs.count() + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [(by[i].score, q) for i, q in truth.items() if by[i].held_out]
    assert sum((s >= 0.7) == q for s, q in test) / len(test) > 0.93
    assert len({r.score for r in got if r.doc_id == 0}) == 1  # equal texts score equally
    assert {r.score for r in knn_quality.score_quality(docs, labels.limit(0)).select("score").distinct().collect()} == {0.5}
    assert knn_quality.score_quality(empty, labels).count() == 0


# ---- 6 -------------------------------------------------------------------------------------------
def targets(sizes):
    """Sharing by weight, the excess of sources at their limit shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2.0 * sizes[s] if full else share * weight[s]
        left -= sum(out[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def test_mixing(docs, clashing, empty, spark):
    rows = corpus()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(ws(t))
    want = targets(sizes)
    got = mixing.mix_report(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, len(ws(t))) for i, t, *_ in rows), key=repr)
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    same(mixing.mix_report(clashing), [tuple(r) for r in got])  # reruns agree
    assert all(r.taken == r.size * len(r.shards) for r in got)
    expected = {round(t, 6): s for s, t in want.items()}
    taken = Counter()
    for r in got:
        s = expected[round(r.target, 6)]
        assert r.source_size == sizes[s]
        taken[s] += r.taken
    for s, t in want.items():
        largest = max(len(ws(x)) for _, x, _, y, _ in rows if y == s)
        assert abs(taken[s] - t) <= 0.01 * t + largest / 2
    given = clashing.withColumnsRenamed({"did": "to", "th": "picks", "found": "upto0", "lo": "__key", "fp": "__s", "held_out": "row", "key": "order"})
    mix = mixing.mix(given, shards=4)
    assert mix.columns == given.columns and mix.exceptAll(given.unionAll(given)).count() == 0
    shards = mixing.mix(docs, shards=4, with_shard=True).collect()
    drawn = Counter()
    for r in shards:
        drawn[r.source] += len(ws(r.text))
    assert drawn == +taken and {r.shard for r in shards} <= set(range(4))
    # What the shards hold is what the report says they draw, and by the tree they share every source's blocks.
    report = Counter((r.doc_id, x) for r in mixing.mix_report(docs, shards=4).collect() for x in r.shards if r.size)
    assert Counter((r.doc_id, r.shard) for r in shards) == report
    assert mixing.mix(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 1), (3, 400)], "i int, quota long")
    got = mixing.split_quotas(quotas, 8, 5).collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        per_source[r.i] += r.n
        per_shard[r.shard] += r.n
        assert r.n >= 0
    assert per_source == {0: 1000, 1: 37, 2: 1, 3: 400} and max(per_shard.values()) - min(per_shard.values()) <= 3
    for i in range(4):
        at = 0
        for r in sorted((r for r in got if r.i == i), key=lambda r: r.shard):
            assert r.first == at
            at += r.n


# ---- 7 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("top", [5, 1 << 20])
def test_base_scores(docs, empty, top):
    rows = corpus()
    toks = [(i, lower(t) + [b"\0end"]) for i, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in toks]
    c = Counter(x for (_, w), h in zip(toks, held) if not h for x in w)
    total = sum(c.values())
    got = sorted(bloom_lm.score_texts(docs, top=top).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score))
    want = [(i, h, len(w), sum(x in c for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w)) for (i, w), h in zip(toks, held)]
    want.sort(key=lambda r: (repr(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in got], [r[5] for r in want])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if top == 5:
        assert bloom_lm.score_texts(empty).count() == 0


@pytest.mark.parametrize("filter_mb", [64, 0])
def test_scores_from_quantised_counts(docs, filter_mb, monkeypatch):
    """With so many bits that nothing collides, the scores are those of the rounded counts."""
    monkeypatch.setattr(bloom_lm, "GROUP", 4000)
    rows = corpus()
    toks = [(i, lower(t) + [None]) for i, t, *_ in rows]
    train = [w for i, w in toks if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    words, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(w, w[1:]))
    total, distinct, mu = sum(words.values()), len(words), bloom_lm.MU

    def rounded(c):
        return (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0

    want = []
    for i, w in toks:
        score = 0.0
        for k, x in enumerate(w):
            p = (rounded(words[x]) + 0.5) / (total + 0.5 * (distinct + 1))
            if k:
                before = rounded(words[w[k - 1]])
                p = (min(rounded(pairs[w[k - 1], x]), before) + mu * p) / (before + mu)
            score += math.log10(p)
        want.append((repr(i), len(w), score))
    got = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in bloom_lm.score_texts(docs, filter_mb=filter_mb, bits=200).collect())
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_buckets_grow_with_the_corpus():
    assert [bloom_lm.n_buckets(5 * n) for n in (0, 1 << 20, 64 << 18, 1 << 28)] == [64, 64, 128, 2048]


def test_filter_never_undercounts():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = r.integers(1, 300, len(keys))
    import pyarrow as pa

    build, _ = bloom_lm._build(bloom_lm.BITS, 1 << 20, 4)
    cut = np.searchsorted(keys >> bloom_lm.shift(64), np.arange(64 + 1, dtype=np.uint64))
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        rows += build(pa.table({"kind": pa.array([1], pa.int32()), "bucket": pa.array([b], pa.int32()), "keys": [keys[part].tobytes()], "counts": [counts[part].tobytes()]})).to_pylist()
    lm = bloom_lm.Filter(4, 64).fill(iter([type("R", (), x) for x in rows]))
    level = bloom_lm.level(counts)
    exact = (2.0 ** (level - 1) + 2.0**level - 1) / 2
    got = lm.counts(keys, bloom_lm.PAIR)
    assert (got >= exact).all() and (got == exact).mean() > 0.9
    assert (lm.counts(keys + np.uint64(1), bloom_lm.PAIR) > 0).mean() < 0.1
    assert (lm.counts(keys[:100], bloom_lm.WORD) == 0).all()


# ---- 8 -------------------------------------------------------------------------------------------
TURNS = [
    (1, 0, "user", "a <s>=x\nboo</s>\n"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", "</s>\n"), (1, 3, "we\nird<s>", "\\<|\\n\\\\|"), (2, 0, None, None), (2, 1, "assistant", None),
    (None, 1, "user", "x"), (3, 0, "assistant", "😀é<\\s>"), (3, 1, "~", "~"), (3, None, "user", "before"), (4, 0, "as\n", "\n"), (5, 0, "u", "<"), (5, 1, "assistant", "s>"), (5, 1, "assistant", "s>"),
    (6, 0, "a", "x</s>\n<s>=a\nx"), (7, 0, "assistant", "<\\s>\\" * 2000 + "<s>" * 2000), (8, 0, "user", "</s>[INST] ok [/INST]"), (8, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS parsed", "2 AS formatted", "3 AS t")
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    report = {r.conv_id: r for r in chat.chat_report(turns).collect()}
    assert set(got) == {x[0] for x in TURNS}
    for i, r in got.items():
        want = sorted(((-1 if t is None else t, a or "", b or "") for c, t, a, b in TURNS if c == i))
        assert [(t.role, t.text) for t in r.parsed] == [x[1:] for x in want]
        loss = "".join(b for _, a, b in want if a == "assistant")
        assert report[i].loss_chars == len(loss) and report[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert report[i].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in want).encode()).hexdigest()
        assert report[i].formatted_chars == len(r.formatted) and report[i].n_turns == len(want)
    assert got[8].attempts == 2 and got[3].attempts == 1
    assert chat.chat_report(turns.limit(0)).count() == 0


# ---- 9 -------------------------------------------------------------------------------------------
def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, r.uniform(-1, 1)]) for _ in range(6)], i % 3) for i in range(400)]
    rows += [(400, rows[7][1], 0), (450, rows[7][1], 0), (500, None, 1), (501, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 1), (600, [], 1), (None, [1.0] * 6, 1), (650, [0.0] * 6, 1), (700, [1.0, 2.0], 0), (701, [3.0, 1.0], 0), rows[50], (750, [1e30] * 6, 0)]
    rows += [(50, rows[50][1], 1), (50, rows[50][1], 2), (51, rows[3][1], 0), (51, rows[9][1], 0), (750, rows[9][1], 0)]  # repeated ids
    # Large components: products past doubles, past longs, and scores that no long holds.
    rows += [(800 + i, [x, 0.0, 1.0], 0) for i, x in enumerate((2e6, 1.5e6, 1.9e6, -2e6, 1.0))] + [(850, [3e9, -2e9, 1.0], 0), (900, [1e12, 1e12, -1e12], 0), (901, [1.1e12, 1e12, -1e12], 0), (902, [-1e12, 1e12, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS v", "2 AS dim", "3 AS b", "4 AS n", "5 AS `row`", "6 AS `no`").repartition(4)
    f32 = lambda x: float(np.float32(x))
    # Exact Python integers; only what no long holds is cut, far beyond all rows but one.
    ok = [(i, [max(-topk.LIMIT, min(topk.LIMIT, math.floor(256 * f32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(ok):
        if q % 50 == 0:
            score = sorted((-sum(g * h for g, h in zip(x, y)), i) for b, (i, y) in enumerate(ok) if a != b and len(x) == len(y))[:5]
            want += [(q, k + 1, i, max(1 - 2**63, min(2**63 - 1, -s))) for k, (s, i) in enumerate(score)]
    same(topk.top_k(df), want)
    same(topk.top_k(df, block=40, queries=3), want)
    assert topk.top_k(df.limit(0)).count() == 0


# ---- 10 ------------------------------------------------------------------------------------------
def shingle_sets(rows, n):
    return [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()) for w in (lower(t) for _, t, *_ in rows)]


def brute_components(rows, n=3, percent=90):
    sets = shingle_sets(rows, n)
    n, big = len(rows), 2**63 - 1
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if d is None else d)
    return [(d, len(sets[i]), None if least[find(i)] == big else least[find(i)]) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("light", [None, 0, 100, 10**6])
def test_jaccard_join(docs, light, monkeypatch):
    if light is not None:  # the result does not depend on the boundary
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    same(jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id"), brute_components(corpus()))


def test_jaccard_edges(spark, clashing, empty):
    r = random.Random(9)
    rows = []
    for g in range(12):  # chains whose ends do not link, and sizes on both sides of the smallest that can link
        size = r.choice([8, 9, 10, 11, 12, 13, 19, 20, 21, 40, 90])
        w = [f"w{r.randrange(10**6)}" for _ in range(size + 2)]
        for k in range(12):
            rows.append((len(rows), " ".join(w + [f"x{g}"] * 0)))
            w = list(w)
            if k % 3 == 0:
                w.append(f"n{g}{k}")
            else:
                w[r.randrange(len(w))] = f"m{g}{k}"
    same(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id"), brute_components(rows))
    found = brute_components(corpus())
    # One row of every component, whatever repeats; rows without words all stay.
    want = [(c,) for c in {c for _, k, c in found if k and c is not None}] + [(d,) for d, k, _ in found if not k] + [(None,)]
    for names in ({}, {"did": "__id", "th": "row", "key": "rows", "lo": "fate_did", "fp": "place", "found": "lost"}):
        given = clashing.withColumnsRenamed(names)
        kept = jaccard_join.drop_near_copies(given)
        assert kept.columns == given.columns
        same(kept.select("doc_id"), want)
        assert kept.exceptAll(given).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0


def test_every_link(spark, docs):
    """No link between different texts is missing, also inside a component."""
    rows = corpus()
    sets = shingle_sets(rows, 3)
    links = [sum(i != j and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)) if a else 0 for i, a in enumerate(sets)]
    assert max(links) > 8
    same(jaccard_join.link_counts(docs), [(d, len(s), k) for (d, *_), s, k in zip(rows, sets, links)])


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)] + [(5, 5), (7, 6)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    same(components(spark.createDataFrame(edges, "a long, b long")), [(x, find(x)) for x in parent])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------
def test_pipeline_stages(spark, docs):
    """Every stage against a brute-force version of it on what the one before kept; the mix against its report."""
    import corpus_pipeline as p

    at, library = docs, rank_library()
    for name, stage in p.STAGES:
        out = store.scratch(stage(spark, at, ""), "test-stage")
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        before = [tuple(r) for r in at.collect()]
        if name == "quality rules":
            same(out.select("doc_id", "text"), [(x[0], t) for x, (_, t, *_) in zip(brute_quality(before), before) if x[-1]])
        if name == "n-gram Jaccard join":
            found = brute_components(before, 5, 80)
            assert len(before) > out.count()
            same(out.select("doc_id"), [(c,) for c in {c for _, k, c in found if k}] + [(d,) for d, k, _ in found if not k])
        if name == "substring dedup":
            same(out.selectExpr("doc_id", "sha2(array_join(array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), ''), ' '), 256)"), [(i, h) for i, _, _, h in brute_substring(before)])
        if name == "mixing sources":
            taken = {r.doc_id: r.taken // r.size for r in mixing.mix_report(at).collect() if r.taken}
            assert Counter(r.doc_id for r in out.select("doc_id").collect()) == taken
            assert out.exceptAll(at.unionAll(at)).count() == 0
        if name == "byte-level BPE":
            same(out.select("doc_id", "n_tokens", F.array_join(F.col("ids").cast("array<string>"), ","), "round_trip"), [(r[0], len(x), ",".join(map(str, x)), True) for r in before for x in [library.encode_ordinary(r[1] or "")]])
        at = out
    assert len(corpus()) > at.count() > 0


def test_pipeline_on_no_rows(spark, empty, tmp_path):
    import corpus_pipeline as p

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
