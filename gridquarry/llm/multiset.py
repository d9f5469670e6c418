"""Document fingerprints by a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector; a text's fingerprint is the sum of its
paragraphs' vectors modulo 2 ** 32 in every lane. So the order of paragraphs
doesn't matter, and a paragraph is inserted or deleted by adding or subtracting
its vector, without the rest of the text. The vector has two parts:

- 8 lanes of the paragraph's SHA-256: equal multisets have equal fingerprints, and
  others differ but by chance. (Against texts made to collide, 8 lanes are few.)
- 128 lanes that add up +1 or -1, by the bits of an MD5, for each pair of
  neighbouring words. Their dot products estimate how many pairs two texts share,
  since signs of different pairs cancel out: that is the likeness.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ._ranges import in_ranges, splits
from ._shared import ROW, arrow_schema, map_rows, numbered, steady, utf8

EXACT, SIGNS, MODULUS = 8, 128, 1 << 32
#: Word pairs whose signs are added up at once.
AT_ONCE = 255 * 64


def paragraphs(text: bytes) -> list[bytes]:
    """The lines that hold a word, as they are."""
    return [p for p in text.split(b"\n") if p.strip()]


def signs(words: list[list[bytes]]) -> np.ndarray:
    """The sign lanes' sum over the word pairs of all paragraphs; one word alone counts as a pair."""
    pairs = [b" ".join(p) for w in words for p in (zip(w, w[1:], strict=False) if len(w) > 1 else (w,))]
    total = np.zeros(SIGNS, np.int64)
    for at in range(0, len(pairs), AT_ONCE):
        digests = b"".join(md5(p).digest() for p in pairs[at : at + AT_ONCE])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, SIGNS // 8), axis=1)
        even = len(bits) // 255 * 255
        total += bits[:even].reshape(-1, 255, SIGNS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[even:].sum(0, dtype=np.int64)
    return 2 * total - len(pairs)


def hashed(some: list[bytes]) -> np.ndarray:
    """The sum of some paragraphs' vectors, as unsigned 32-bit lanes."""
    digests = np.frombuffer(b"".join(sha256(p).digest() for p in some), ">u4").reshape(-1, EXACT)
    return np.concatenate([digests.sum(0, dtype=np.uint64), signs([p.split() for p in some]).astype(np.uint64)]).astype(np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    return hashed(paragraphs(utf8(text)))


def shown(lanes: np.ndarray) -> str:
    """A fingerprint as hex digits, 8 for each lane."""
    return lanes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of word pairs that two fingerprints say their texts have in common: 2 ab / (aa + bb), 0 to 1; 1 for equal ones."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (lanes[EXACT:].view(np.int32).astype(np.float64) for lanes in (a, b))
    both = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2 * float(x @ y) / both)) if both else 0.0


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its row number, id, n_chars and fingerprint."""
    kind = StructType([StructField(ROW, LongType()), StructField("id", docs.schema[id].dataType), StructField("n_chars", LongType()), StructField("fingerprint", StringType())])
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = batch.columns
            texts = texts.to_pylist()
            yield pa.RecordBatch.from_arrays([rows, ids.cast(schema.field(1).type), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([shown(fingerprint(t)) for t in texts], schema.field(3).type)], schema=schema)

    return numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text").mapInArrow(run, kind).withColumnRenamed("id", id)


def lanes(fingerprint: Column | str) -> Column:
    """A fingerprint's lanes as an array of longs."""
    hexes = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.transform(F.sequence(F.lit(0), F.lit(EXACT + SIGNS - 1)), lambda k: F.conv(hexes.substr(k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def summed(prints: DataFrame, id: str, fingerprint: str, times: Column | None = None) -> DataFrame:
    """(id, fingerprint): for each id the sum of its rows' fingerprints, each ``times`` over; negative times delete.

    Sums are combined before the shuffle, a lane each, so an id may have any number of rows.
    """
    each = prints.select(F.col(id).alias("id"), lanes(fingerprint).alias("lanes"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    total = each.groupBy("id").agg(*(F.sum(F.col("lanes")[k] * F.col("times")).alias(f"lane{k}") for k in range(EXACT + SIGNS)))
    digits = [F.lower(F.lpad(F.hex(F.pmod(F.col(f"lane{k}"), F.lit(MODULUS))), 8, "0")) for k in range(EXACT + SIGNS)]
    return total.select(F.col("id").alias(id), F.concat(*digits).alias(fingerprint))


def edited(prints: DataFrame, edits: DataFrame, id: str = "doc_id", text: str = "text", times: str = "times") -> DataFrame:
    """The (id, fingerprint) of ``prints`` after ``edits`` (id, text, times): paragraphs inserted (1) or deleted (-1).

    The texts aren't read again. An id that only edits have is a new document; a null text or null times change nothing.
    """
    kind = StructType([StructField("id", edits.schema[id].dataType), StructField("fingerprint", StringType()), StructField("times", LongType())])
    changes = map_rows(edits.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(times).alias("times")), kind, lambda c: [c[0], [shown(fingerprint(t)) for t in c[1]], c[2]])
    both = prints.select(F.col(id).alias("id"), "fingerprint", F.lit(1).cast("long").alias("times")).unionByName(changes)
    return summed(both, "id", "fingerprint", F.col("times")).withColumnRenamed("id", id)


def edited_and_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its row number, id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text has its last quarter of code points, rounded down, replaced by
    as many of the next document's first (or all of them, if it has fewer). The
    next document is that of the next id (null last; rows with one id follow each
    other as they are stored), after the last the first. Only the paragraphs from the edit on are hashed anew.
    Null texts count as empty. Texts without words have fingerprint zero, all alike. An
    empty table gives no rows; other columns are not read, so their names may
    clash. A text of any length is hashed whole, ``AT_ONCE`` word pairs at a time.

    Ids alone are put into ranges first. Then texts are shuffled once, to their
    range, and the first text of each range also to the one before it, where it ends the row of neighbours.
    Rows are numbered in both scans, so a table that is not a stored one is stored first.
    """
    rows = numbered(steady(docs), F.col(id).alias("id"), F.col(text).alias("text"))
    n, kind = splits(docs), rows.schema["id"].dataType
    order = [F.col("id").asc_nulls_last(), F.col(ROW).asc()]
    keys = in_ranges(rows.select("id", ROW), order, n)
    starts = [(r["id"] is None, r["id"] if r["id"] is not None else 0, r[ROW]) for r in keys.where("__place = 0").orderBy("__cell").collect()]  # one for each range

    @F.arrow_udf("array<int>")
    def ranges(ids: pa.Array, numbers: pa.Array) -> pa.Array:
        """A row's range, and where it is a range's first also the one before."""
        out = []
        for i, number in zip(ids.to_pylist(), numbers.to_pylist(), strict=True):
            key = (i is None, 0 if i is None else i, number)
            at = bisect_right(starts, key) - 1
            out.append([at, (at or len(starts)) - 1] if starts[at] == key else [at])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select(ROW, "id", "text", F.posexplode(ranges("id", ROW)).alias("beyond", "range")).repartitionById(max(len(starts), 1), F.col("range"))
    out = StructType([StructField(ROW, LongType()), StructField("id", kind), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(StructField(c, DoubleType()) for c in ("near_edited", "near_next"))])
    schema = arrow_schema(out)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], None
        for batch in batches:
            for number, i, t, beyond in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = _Document(number, i, t or "")
                if before is not None:
                    held.append(before.followed_by(here))
                before = None if beyond else here
                if len(held) >= 256:
                    yield _batch(held, schema)
                    held = []
        if held:
            yield _batch(held, schema)

    sort = ["range", "beyond", F.col("id").asc_nulls_last(), ROW]
    return dealt.sortWithinPartitions(*sort).select(ROW, "id", "text", (F.col("beyond") > 0).alias("beyond")).mapInArrow(neighbours, out).withColumnRenamed("id", id)


class _Document:
    """A text's fingerprint in two parts: of the paragraphs before the edit and of the rest."""

    def __init__(self, row: int, id: object, text: str):
        self.row, self.id, self.text = row, id, text
        self.cut = len(text) - len(text) // 4
        self.stays = text.rfind("\n", 0, self.cut) + 1  # the paragraph in which the edit begins starts here
        self.kept = fingerprint(text[: self.stays])
        self.whole = self.kept + fingerprint(text[self.stays :])

    def followed_by(self, other: _Document) -> tuple:
        tail = self.text[self.stays : self.cut] + other.text[: len(self.text) - self.cut]
        new = self.kept + fingerprint(tail)
        digest = sha256(utf8(self.text[: self.stays]))
        digest.update(utf8(tail))
        return self.row, self.id, len(self.text), digest.hexdigest(), shown(self.whole), shown(new), likeness(self.whole, new), likeness(self.whole, other.whole)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
