import math
import random
from collections import Counter
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridquarry.llm import _ranges, balls, multiset, resampling
from gridquarry.llm._shared import ROW, numbered

from .conftest import random_text

# Fingerprints


def plain_print(text):
    """Lane by lane, pair by pair."""
    exact, sign = [0] * 8, [0] * 128
    for p in text.split("\n"):
        words = p.encode().split()
        if words:
            d = sha256(p.encode()).hexdigest()
            exact = [(x + int(d[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(exact)]
            for pair in [f"{a.decode()} {b.decode()}" for a, b in zip(words, words[1:], strict=False)] or [words[0].decode()]:
                bits = f"{int(md5(pair.encode()).hexdigest(), 16):0128b}"
                sign = [s + (1 if b == "1" else -1) for s, b in zip(sign, bits, strict=True)]
    return "".join(f"{x % 2**32:08x}" for x in exact + sign), sign


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    both = sum(x * x for x in a[1]) + sum(x * x for x in b[1])
    return min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a[1], b[1], strict=True)) / both)) if both else 0.0


def test_fingerprints_are_plain(spark, frame, corpus):
    docs = frame(corpus)
    stored = sorted(numbered(docs, "doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r[ROW]))
    want, prints = [], [plain_print(r["text"] or "") for r in stored]
    for k, r in enumerate(stored):
        text, n = r["text"] or "", len(r["text"] or "")
        new = text[: n - n // 4] + (stored[(k + 1) % len(stored)]["text"] or "")[: n // 4]
        changed = plain_print(new)
        want.append((r["doc_id"], n, sha256(new.encode()).hexdigest(), prints[k][0], changed[0], plain_likeness(prints[k], changed), plain_likeness(prints[k], prints[(k + 1) % len(stored)])))
    got = [tuple(r) for r in multiset.edited_and_next(docs).drop(ROW).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    plain = {(r[ROW], r["doc_id"]): p[0] for r, p in zip(stored, prints, strict=True)}
    assert {(r[ROW], r["doc_id"]): r["fingerprint"] for r in multiset.fingerprints(docs).collect()} == plain


def test_neighbours_of_few_rows(spark, frame, corpus):
    assert multiset.edited_and_next(frame([])).count() == 0
    one = multiset.edited_and_next(frame(corpus[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = [(5, "abcd efgh", None, None, 0)] * 400  # one id, over many ranges
    rows = multiset.edited_and_next(frame(same)).collect()
    assert len(rows) == 400 and {r["edited_sha256"] for r in rows} == {sha256(b"abcd efab").hexdigest()}


def test_paragraphs_come_and_go(spark):
    rng = random.Random(4)
    texts = {k: [random_text(rng, 9) for _ in range(6)] for k in range(5)}
    docs = spark.createDataFrame([(k, "\n".join(p)) for k, p in texts.items()], "doc_id long, text string")
    edits = [(0, texts[0][2], -1), (0, "a new line", 1), (1, texts[1][0], 2), (7, "new document\nof two lines", 1), (2, None, 1), (3, "no times", None)]
    edits += [(4, "hot", 1)] * 300 + [(4, "hot", -1)] * 299
    got = multiset.edited(multiset.fingerprints(docs), spark.createDataFrame(edits, "doc_id long, text string, times int").repartition(5)).collect()
    after = {**texts, 0: [*texts[0][:2], *texts[0][3:], "a new line"], 1: [texts[1][0], *texts[1], texts[1][0]], 4: ["hot", *texts[4]], 7: ["of two lines", "new document"]}
    for k in after:
        rng.shuffle(after[k])
    assert dict(map(tuple, got)) == {k: plain_print("\n".join(p))[0] for k, p in after.items()}


def test_likeness_is_the_share_of_pairs():
    rng = random.Random(9)
    words = [random_text(rng, 1) + str(k) for k in range(3000)]
    for shared in (0, 250, 500, 750, 1000):
        a, b = words[:1000], words[1000 - shared : 2000 - shared]
        assert abs(multiset.likeness(multiset.fingerprint(" ".join(a)), multiset.fingerprint(" ".join(b))) - shared / 1000) < 0.2


# Ranks over a whole table


def test_ranks_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, 1, 1, 5, None]), k) for k in range(3000)]
    got = _ranges.ranked(spark.createDataFrame(rows, "a long, b long").repartition(4), [F.col("a").desc_nulls_last(), F.col("b").asc()], 7, "place").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 3001))


# Resampling


def plain_words(text):
    out = [""]
    for ch in text or "":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        out = [*out[:-1], out[-1] + ch] if ch > "\x7f" or ch in "0123456789abcdefghijklmnopqrstuvwxyz" else [*out, ""] if out[-1] else out
    return [w for w in out if w]


def plain_features(text, longest, n):
    w = plain_words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_is_plain(spark, frame, corpus, longest):
    n = 200  # buckets collide
    docs, target = frame(corpus), spark.createDataFrame([(t,) for _, t, *_ in corpus[::7]], "other string")
    features = [plain_features(t, longest, n) for _, t, *_ in corpus]
    source, goal = Counter(b for f in features for b in f), Counter(b for _, t, *_ in corpus[::7] for b in plain_features(t, longest, n))
    whole, aim = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (whole + n) / ((source[b] + 1) * (aim + n)))) for b in range(n)]
    want, some = Counter(), []
    for (i, t, *_), f in zip(corpus, features, strict=True):
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        row = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
        want[row] += 1
        if len(plain_words(t)) >= 20:
            some.append((-row[3], row[0] is None, row[0] or 0))
    got = resampling.resampled(docs, target, target_text="other", longest=longest, n=n).collect()
    assert Counter(tuple(r)[1:5] for r in got) == want
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 10 * len(some) // 100 + 1)) and [d[1:] for d in drawn] == sorted(some)[: len(drawn)]


def test_resampling_of_nothing(spark, frame, corpus):
    assert resampling.resampled(frame([]), frame(corpus)).count() == 0
    rows = resampling.resampled(frame(corpus[:30]), frame([])).collect()
    assert len(rows) == 30


def test_suffix_array_runs():
    """Order and common prefixes by comparing suffixes; parts cut anywhere count the same."""
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    number = {b"a": 1, b"b": 2, b"cc": 3}
    ids, room = np.array([number[w] for t in texts for w in t]), np.array([len(t) - i for t in texts for i in range(len(t))])
    for depth in (1, 2, 5):
        order, lcp = resampling.suffix_array(ids, room, depth)
        tails = [tuple(ids[p : p + min(depth, room[p])]) for p in order]
        assert tails == sorted(tails) and sorted(order) == list(range(len(ids)))
        assert list(lcp[1:]) == [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(tails, tails[1:], strict=False)]
    found = Counter((d, b) for doc, bucket in resampling.buckets(texts, 5, 1000) for d, b in zip(doc.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((d, b) for d, t in enumerate(texts) for b in plain_features(b" ".join(t).decode(), 5, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10)), pa.array(["x y z"] * 10)], names=["i", "t"]) for k in range(0, 50, 10)]
    assert [i for held, _ in resampling.parts(iter(batches)) for [i] in held] == list(range(50))


# Clusters


def plain_clusters(rows, width, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, sha256(f"3:{kept[n][0]}".encode()).hexdigest()))[:k]
    centroids = [kept[n][1] for n in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    by = Counter()
    for _, d, c in found:
        by[c] += d
    return Counter((i, c, d, by[c], sum(by.values()), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


@pytest.mark.parametrize("scale", [1.0, 5000.0])  # distances as doubles and as longs
def test_clusters_are_plain(spark, scale, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 4)) * 3 * scale
    rows = [(int(k), (middles[k % 6] + rng.normal(size=4) * scale * (0.05 if k % 6 else 2)).tolist()) for k in range(700)]
    rows += [(2000 + k, [0.25 * scale, -1.0, 0.0, 2.0]) for k in range(400)]  # one vector often
    rows += [(3000, None), (3001, []), (3002, [1.0, 2.0]), (3003, [1.0, None, 2.0, 3.0]), (3004, [1.0, float("nan"), 2.0, 3.0]), (3005, [1.0, float("inf"), 2.0, 3.0]), rows[5], rows[5], (None, rows[6][1])]
    frame = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], "vec_id long, embedding array<float>, id string, vector string, points int").repartition(3)
    got = Counter(tuple(r) for r in balls.clustered(frame, width=4).drop(ROW).collect())
    assert got == plain_clusters(rows, 4)
    assert balls.clustered(frame.where("false"), width=4).count() == 0
    few = Counter(tuple(r) for r in balls.clustered(frame.where("vec_id < 3"), width=4).drop(ROW).collect())
    assert few == plain_clusters(rows[:3], 4)


def test_trees_hold_their_points():
    rng = np.random.default_rng(6)
    for points in (rng.integers(-50, 50, (1000, 5)), np.repeat(rng.integers(-9, 9, (3, 5)), 100, 0), np.zeros((200, 5), int), rng.integers(0, 9, (1, 5))):
        order, nodes, sums = balls.tree(points)
        assert sorted(order) == list(range(len(points)))
        placed = points[order]
        radius = balls.radii(placed, nodes, sums)
        for (lo, hi, first), s, r in zip(nodes, sums, radius, strict=True):
            here = placed[lo:hi]
            assert (here.sum(0) == s).all() and np.sqrt(np.square(here - s / len(here)).sum(1)).max() <= r + 1e-9
            if first >= 0:
                assert (nodes[first][0], nodes[first][1], nodes[first + 1][1]) == (lo, nodes[first + 1][0], hi)
        for _ in range(20):
            centroids = rng.integers(-60, 60, (4, 5))
            whole, owner, leaves = balls.settled(nodes, sums, radius, centroids)
            nearest = np.square(placed[:, None] - centroids).sum(2).argmin(1)
            parts = [balls.members(nodes, np.array([w])) for w in whole] + [balls.members(nodes, leaves)]
            assert sorted(np.concatenate(parts)) == list(range(len(points)))
            assert all((nearest[p] == o).all() for p, o in zip(parts, owner, strict=False))
            assert (balls.distances(placed, centroids) == np.square(placed[:, None] - centroids).sum(2)).all()


def test_balls_spare_distances():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(m, 3, (2000, 8)) for m in (0, 500, 1000)]).astype(np.int64)
    order, nodes, sums = balls.tree(points)
    whole, _, leaves = balls.settled(nodes, sums, balls.radii(points[order], nodes, sums), np.array([[0] * 8, [500] * 8, [1000] * 8]))
    assert len(balls.members(nodes, leaves)) < 100 and len(whole) < 20


def test_vectors_too_large_raise(spark):
    with pytest.raises(Exception, match="beyond 131072"):
        balls.clustered(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), width=1).collect()
