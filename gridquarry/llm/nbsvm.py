"""Quality classifier: Naive Bayes features in a linear support vector machine.

Features are indicators of n-grams in the whole text: words, pairs of words,
triples of bytes, and runs of one word or line, hashed into a space of fixed size,
so the model is bounded; one more indicator tells the order of size of the text.
Each is scaled by the log-ratio of its class counts; dual coordinate descent fits
the hinge loss, and a sigmoid fitted on rows left out turns margins into scores.
Training takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._shared import ROW, cut, map_rows, numbered, utf8

BITS = 18
#: Labelled rows taken for training at most; those with the least hashes of their ids.
SAMPLE = 4000
#: And the places of n-grams that these rows have in all, at most: 4 bytes each on the driver.
SAMPLE_PLACES = 32_000_000
ROUNDS, COST, SMOOTH = 12, 1.0, 1.0


def features(text: str | None) -> np.ndarray:
    """Sorted places of the text's n-grams in the hashed space; none for an empty text."""
    b = utf8(text)
    words = b.split()
    if not words:
        return np.zeros(0, np.int32)
    distinct: dict[bytes, int] = {}
    ids = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), np.int64, len(words))
    h = np.fromiter(map(xxh3_64_intdigest, distinct, repeat(1)), np.uint64)
    shift = np.uint64(64 - BITS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    again = int(np.count_nonzero(np.diff(ids) == 0))
    form = [b"\n size", b"%d" % len(words).bit_length()], [b"\n lines", b"%d" % (10 * len(set(lines)) // len(lines))], [b"\n again", b"%d" % (10 * again // len(ids))]
    form += tuple([b"\n runs", b"%d" % k] for k in range(again.bit_length()))
    some = [h >> shift, np.array([xxh3_64_intdigest(b" ".join(x), 2) for x in form], np.uint64) >> shift]
    if len(ids) > 1:
        pairs = np.unique(ids[:-1] * len(distinct) + ids[1:])
        some.append((h[pairs // len(distinct)] * np.uint64(0x9E3779B97F4A7C15) + (h[pairs % len(distinct)] ^ np.uint64(0x5851F42D4C957F2D))) * np.uint64(0xD6E8FEB86659FD93) >> shift)
    if len(b) > 2:
        x = np.frombuffer(b, np.uint8).astype(np.uint32)
        triples = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        some.append((np.unique(triples).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> shift)
    return np.unique(np.concatenate(some)).astype(np.int32)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Each place's log-ratio of smoothed shares of the class's indicators."""
    good, bad = (SMOOTH + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k] or [np.zeros(0, np.int32)]), minlength=1 << BITS) for k in (1, 0))
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss machine, by coordinate descent on its dual.

    Rows have length 1; the rarer class costs more, so that both count alike.
    """
    w, y = np.zeros(len(ratio) + 1), np.where(labels == 1, 1.0, -1.0)
    xs = [v / (np.linalg.norm(v) or 1.0) for v in (ratio[r] for r in rows)]
    squares = [x @ x + 1.0 for x in xs]
    share = np.array([max((labels == k).mean(), 1e-9) for k in (0, 1)])
    upper = COST * 0.5 / share[labels]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            slope = y[i] * (xs[i] @ w[rows[i]] + w[-1]) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * xs[i]
                w[-1] += step
                alpha[i] = new
    return w


def margins(rows: list[np.ndarray], weights: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.array([(weights[r] @ (v := ratio[r])) / (np.linalg.norm(v) or 1.0) + weights[-1] for r in rows])


def calibrated(m: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of the sigmoid from margins to the chance of label 1, by Newton's method on smoothed targets."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    t = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.stack([m, np.ones(len(m))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of the places, scaled by ratio and slope; offset). Without rows of both classes every score is the share of good ones."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros((2, 1 << BITS), np.float32), float(np.log(share / (1 - share)))
    out = np.zeros(len(rows))
    for k in range(3):  # margins of rows left out
        held = np.arange(len(rows)) % 3 == k
        part, y = [r for r, h in zip(rows, held, strict=True) if not h], labels[~held]
        if len(set(y.tolist())) == 2:
            ratio = log_ratios(part, y)
            out[held] = margins([r for r, h in zip(rows, held, strict=True) if h], descend(part, y, ratio), ratio)
    slope, offset = calibrated(out, labels)
    ratio = log_ratios(rows, labels)
    w = descend(rows, labels, ratio)
    return np.stack([w[:-1] * ratio * slope, ratio]).astype(np.float32), float(w[-1] * slope + offset)


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, places: int = SAMPLE_PLACES) -> DataFrame:
    """For each row of ``docs``: its row number, id, held_out, score and predicted.

    held_out: crc32 of the id as text, modulo 3, is 1; such rows' labels are never
    used. Of the others, at most ``sample`` labelled ids (those with the least
    hashes, as long as their n-grams have ``places`` places at most) train the
    model, which sees the text alone. Null labels are no labels; a null id isn't
    held out and has no label; an id labelled twice has the greater label, one
    stored twice trains once, by the text with the least hash. Null and empty texts
    have no n-grams and score by the offset. Equal texts score alike; a score of
    one half predicts 1. An empty table gives no rows; other columns are not read,
    so their names may clash. Texts of any length are scored whole, by at most
    2 ** 18 places each.
    """
    docs = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = docs.schema["id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.select(F.col(id).cast(kind).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("label").alias("label")).where(~held).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = docs.where("id IS NOT NULL").join(F.broadcast(known), "id")  # at most ``sample`` rows of an id and a number
    chosen = chosen.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))  # each task keeps one text of an id
    part = cut(map_rows(chosen, f"id {kind}, label int, places binary", lambda c: [c[0], c[1], [features(t).tobytes() for t in c[2]]]))
    order = F.xxhash64("id")
    sizes = part.select("id", order.alias("hash"), F.length("places").alias("bytes")).collect()  # ``sample`` rows
    sizes.sort(key=lambda r: (r["hash"], r["id"]))
    fits = sum(total <= 4 * places for total in np.cumsum([r["bytes"] for r in sizes], dtype=np.int64).tolist())
    got = part.where(order <= sizes[fits - 1]["hash"]).collect() if fits else []
    got.sort(key=lambda r: xxh3_64_intdigest(str(r["id"])))
    weights, offset = fit([np.frombuffer(r["places"], np.int32) for r in got], np.array([r["label"] for r in got], np.int64))
    model = docs.sparkSession.sparkContext.broadcast((weights, offset))  # of a fixed size: 2 floats for each place

    def rows(columns):
        (scaled, ratio), bias = model.value
        found = [features(t) for t in columns[2]]
        m = np.array([scaled[r].sum(dtype=np.float64) / (np.linalg.norm(ratio[r]) or 1.0) for r in found]) + bias
        return [columns[0], columns[1], (1 / (1 + np.exp(-np.clip(m, -60, 60)))).tolist()]

    out = map_rows(docs, f"{ROW} long, id {kind}, score double", rows)
    return out.select(ROW, F.col("id").alias(id), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
