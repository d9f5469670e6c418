"""Importance resampling towards a target, by hashed n-grams from word-id suffix arrays.

A part of a partition is turned into word ids; its suffixes are sorted as deep as
the longest n-gram, and neighbours' common prefixes (LCP) are counted. A run of
neighbours that share k words is one k-gram with all its occurrences: it is hashed
once, and its bucket is scattered back to the places where it occurs. Buckets are
then counted, and in a second pass their gains are summed for each document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._ranges import ranked, splits
from ._shared import LOWER, ROW, arrow_schema, cut, numbered, utf8

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Words of a part whose suffixes are sorted together; a longer text is a part of its own.
PART_WORDS = 1 << 20
#: Digits, letters (as lower case) and all beyond ASCII make words; other bytes part them.
WORD_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their next ``depth`` words, and how many words each shares with the one before it.

    ids: of words, from 1; room: words from a place to its document's end, beyond which nothing is compared.
    """
    ahead = [ids] + [np.where(room > k, np.roll(ids, -k), 0) for k in range(1, depth)]
    order = np.lexsort(ahead[::-1]) if depth > 1 else np.argsort(ids, kind="stable")
    lcp, alike = np.zeros(len(ids), np.int64), np.ones(max(len(ids) - 1, 0), bool)
    for a in ahead:
        a = a[order]
        alike &= (a[1:] == a[:-1]) & (a[1:] > 0)
        lcp[1:] += alike
    return order, lcp


def buckets(texts: list[list[bytes]], longest: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``longest``: (document, bucket) of every occurrence of an n-gram so long in ``texts``, in no order."""
    number = defaultdict(int)
    number.default_factory = lambda: len(number) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    vocabulary, doc = [b"", *number], np.repeat(np.arange(len(texts)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    order, lcp = suffix_array(ids, room, longest)
    for k in range(1, longest + 1):
        whole = room[order] >= k
        starts = whole & (lcp < k)
        hashed = [crc32(b" ".join(map(vocabulary.__getitem__, ids[p : p + k].tolist()))) % n for p in order[starts].tolist()]
        run = np.cumsum(starts)[whole] - 1
        yield doc[order[whole]], np.array(hashed, np.int64)[run]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(columns before the text, words of the texts) of some ``PART_WORDS`` words at a time."""
    held, texts, size = [], [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            texts.append(words(text))
            size += len(texts[-1])
            if size >= PART_WORDS:
                yield held, texts
                held, texts, size = [], [], 0
    if texts:
        yield held, texts


def bucket_counts(docs: DataFrame, text: str, longest: int = LONGEST, n: int = BUCKETS) -> np.ndarray:
    """How many occurrences of n-grams all texts have in each bucket. A task sends ``n`` rows at most, and so much comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for _, texts in parts(batches):
            for _, found in buckets(texts, longest, n):
                total += np.bincount(found, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    total = np.zeros(n, np.int64)
    for bucket, c in found:
        total[bucket] = c
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the source, rounded down."""
    n, whole, goal = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(whole + n) / (float(s + 1) * float(goal + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, id: object) -> int:
    """Thousandths of the Gumbel noise that seed and id give, rounded down; a null id counts as an empty one."""
    h = int(sha256(f"{seed}:{'' if id is None else id}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, n: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """For each row of ``docs``: its row number, id, n_features, weight, score, and rank if it is drawn.

    Null texts have no words, weight 0 and are never drawn where ``least_words``
    is positive. ``percent`` of the documents with ``least_words`` words are drawn,
    those of the highest scores; ties go to the smaller id (null last), then to the
    first row. Rows that repeat an id are rows like any other, with the same noise.
    Without documents there are no rows; without a target every bucket's count there is 0. Other
    columns are not read, so their names may clash. Whole texts of any length are
    read; a task holds a part of ``PART_WORDS`` words, or one text that is longer.
    """
    gain = gains(bucket_counts(docs, text, longest, n), bucket_counts(target, target_text, longest, n))
    rows = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = StructType([StructField(ROW, LongType()), StructField("id", rows.schema["id"].dataType), *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    scored = cut(rows.mapInArrow(_scorer(gain, longest, n, seed, arrow_schema(kind)), kind))
    some = scored.where(F.col("n_words") >= least_words)
    drawn = percent * some.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col(ROW).asc()]
    places = ranked(some, order, splits(scored), "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select(ROW, F.col("id").alias(id), "n_features", "weight", "score", "rank")


def _scorer(gain: np.ndarray, longest: int, n: int, seed: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in parts(batches):
            features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for doc, bucket in buckets(texts, longest, n):
                features += np.bincount(doc, minlength=len(texts))
                np.add.at(weight, doc, gain[bucket])
            rows, ids = zip(*held, strict=True)
            noise = np.array([gumbel(seed, i) for i in ids], np.int64)
            columns = [rows, ids, [len(t) for t in texts], features, weight, weight + noise]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return score
