"""Exact deduplication by Grace hashing.

Each map task folds its own copies into one record before the shuffle, so a text
that a third of all rows share arrives once from each task. After the shuffle by
content hash, each task folds what came, in the same way: records enter an
open-addressing table that compares complete contents; when it outgrows its
memory, it and all later records go to spill files by the hash of the next level,
and each file is folded by itself.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from ._shared import ROW, SPACE, arrow_schema, cut, map_rows, numbered, utf8

TABLE_BYTES, FANOUT = 64 << 20, 16


def normalised(text: str | None) -> bytes:
    """The text without ASCII white space; null is empty."""
    return utf8(text).translate(None, SPACE)


def better(a: tuple, b: tuple) -> bool:
    """Whether a's row goes before b's: more code points, then the smaller id, null last. Both: (code points, id, rows like that, rows)."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def folded(a: tuple, b: tuple) -> tuple:
    if a[:2] == b[:2]:
        return (a[0], a[1], a[2] + b[2], a[3] + b[3])
    return (*(a if better(a, b) else b)[:3], a[3] + b[3])


class Table:
    """Open addressing with linear probing: slots hold places in ``contents`` and ``values``."""

    def __init__(self, level: int):
        self.level, self.slots, self.hashes, self.contents, self.values, self.bytes = level, [-1] * 64, [], [], [], 0

    def hash(self, content: bytes) -> int:
        return xxh3_64_intdigest(content, self.level)

    def add(self, content: bytes, value: tuple) -> None:
        h, size = self.hash(content), len(self.slots) - 1
        at = h & size
        while (place := self.slots[at]) >= 0:
            if self.hashes[place] == h and self.contents[place] == content:
                self.values[place] = folded(self.values[place], value)
                return
            at = (at + 1) & size
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 300
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            size = len(self.slots) - 1
            for place, h in enumerate(self.hashes):
                at = h & size
                while self.slots[at] >= 0:
                    at = (at + 1) & size
                self.slots[at] = place

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return zip(self.contents, self.values, strict=True)


def fold(records: Iterator[tuple[bytes, tuple]], most: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[bytes, tuple]]:
    """Each distinct content of ``records`` once, with its folded value, in about ``most`` bytes of memory.

    One content is one record at any level, so only different contents are ever
    spilled apart; hashes of each level have another seed.
    """
    table = Table(level)
    for content, value in records:
        table.add(content, value)
        if table.bytes > most and len(table.contents) > 1:
            break
    else:
        yield from table.items()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:  # this task's own; nobody else reads it
        files = [open(f"{folder}/{i}", "w+b") for i in range(FANOUT)]  # noqa: SIM115
        try:
            for source in (table.items(), records):
                for content, value in source:
                    pickle.dump((content, value), files[table.hash(content) >> 60], -1)
                table = Table(level)
            for f in files:
                f.seek(0)
                yield from fold(_read(f), most, level + 1)
                f.close()
        finally:
            for f in files:
                f.close()


def _read(f) -> Iterator[tuple[bytes, tuple]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For each row of ``docs``: its row number, id, keep_id, group_size, kept and text_sha256.

    Rows are equal when their texts are, without ASCII white space; null is
    empty. The row with the most code points stays, then the smallest id (null
    last), then the first row. Rows that repeat an id are rows like any other:
    one of the group stays. Ids are integers or null. An empty table gives no
    rows; other columns are not read, so their names may clash. Texts of any length
    are compared whole; a task holds ``table_bytes`` of them and one more.
    """
    docs = numbered(docs, F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    partial = StructType([StructField("hash", LongType()), StructField("content", BinaryType()), StructField("points", LongType()), StructField("id", LongType()), StructField("alike", LongType()), StructField("rows", LongType())])
    total = StructType([StructField("sha", BinaryType()), StructField("points", LongType()), StructField("keep_id", LongType()), StructField("alike", LongType()), StructField("group_size", LongType())])

    def fold_rows(batches):
        records = ((normalised(t), (len(t or ""), i, 1, 1)) for b in batches for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(((xxh3_64_intdigest(c) >> 1, c, *v) for c, v in fold(records, table_bytes)), arrow_schema(partial))

    def fold_partials(batches):
        records = ((c, tuple(v)) for b in batches for c, *v in zip(*(x.to_pylist() for x in b.columns[1:]), strict=True))
        yield from _batches(((sha256(c).digest(), *v) for c, v in fold(records, table_bytes)), arrow_schema(total))

    groups = cut(docs.select("id", "text").mapInArrow(fold_rows, partial).repartition("hash").mapInArrow(fold_partials, total))
    members = cut(map_rows(docs.select(ROW, "id", "text"), f"{ROW} long, id long, points long, sha binary", lambda c: [c[0], c[1], [len(t or "") for t in c[2]], [sha256(normalised(t)).digest() for t in c[2]]]))
    if groups.where("alike > 1").isEmpty():
        keepers = groups.withColumn("first", F.lit(None).cast("long"))
    else:  # ids that repeat: the first of the rows alike stays
        firsts = members.groupBy("sha", "id", "points").agg(F.min(ROW).alias("first"))
        tied = groups.where("alike > 1").alias("g").join(firsts.alias("f"), (F.col("g.sha") == F.col("f.sha")) & F.col("g.keep_id").eqNullSafe(F.col("f.id")) & (F.col("g.points") == F.col("f.points")))
        keepers = groups.join(tied.select("g.sha", "first"), "sha", "left")
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("m.points") == F.col("k.points")) & F.coalesce(F.col("first") == F.col(ROW), F.lit(True))
    return members.alias("m").join(keepers.alias("k"), "sha").select(ROW, F.col("id").alias(id), "keep_id", "group_size", best.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some MB."""
    held, size, widest = [], 0, next((i for i, f in enumerate(schema) if pa.types.is_binary(f.type)), None)
    for n in count():
        row = next(rows, None)
        if row is not None:
            held.append(row)
            size += 64 + len(row[widest])
        if held and (row is None or size > most):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
        if row is None:
            return
