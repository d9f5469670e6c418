"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits; two link when at most 3 differ. Of its two halves of
32 bits, one then differs in at most one bit. The anchors of a half are the words
of the perfect [31, 26] Hamming code with one free bit beside it: every half lies
within 1 (the covering radius) of an anchor. So if f and g link, the anchor
nearest to f's half lies within 1 + 1 of g's. Each distinct fingerprint is
replicated to all anchors within 2 of its halves (17 at most for each half), and
per anchor those whose home it is are compared with all that came.

Rows with equal fingerprints are one node, so copies are never paired; per anchor
the comparison is an equi-join, whose skewed keys Spark splits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from ._shared import LOWER, ROW, cut, map_rows, numbered, utf8
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _near_anchors() -> list[list[int]]:
    """For each syndrome of the [31, 26] code, what to flip in a half to reach each anchor within 2 of it; the nearest first."""
    out = []
    for s in range(32):
        near = [0] if s == 0 else [1 << (s - 1)]
        at_two = [] if s == 0 else [1 << (i - 1) | 1 << (j - 1) for i in range(1, 32) for j in [i ^ s] if i < j]
        out.append([near[0], near[0] | 1 << 31, *at_two])
    return out


def anchor_rows(fps: DataFrame) -> DataFrame:
    """(half, anchor, fp, home) for each anchor to which ``fps`` (fp, distinct) go."""
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in near]) for near in _near_anchors()])

    def anchors(half: int):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        # bit k of the syndrome: parity of the bits at places whose number has bit k
        masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
        syndrome = sum(((F.bit_count(bits.bitwiseAND(F.lit(m))) % 2) * F.lit(1 << k) for k, m in enumerate(masks)), F.lit(0))
        rows = fps.select("fp", bits.alias("bits"), F.posexplode(F.element_at(flips, (syndrome + 1).cast("int"))).alias("place", "flip"))
        return rows.select(F.lit(half).alias("half"), F.col("bits").bitwiseXOR(F.col("flip")).alias("anchor"), "fp", (F.col("place") == 0).alias("home"))

    return anchors(0).union(anchors(1))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): all pairs u < v of the distinct fingerprints ``fps`` (fp) that differ in at most 3 bits."""
    rows = anchor_rows(fps)
    home = rows.where("home").select("half", "anchor", F.col("fp").alias("u"))
    came = rows.select("half", "anchor", F.col("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    return home.join(came, (home.half == came.half) & (home.anchor == came.anchor) & (F.col("u") < F.col("v")) & close).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its row number, id, fingerprint, the component's least id, and whether it is the row that stays.

    Null texts count as empty; texts without words have fingerprint 0 and link
    like any other. Null ids sort last. Of equal least ids the first row stays.
    An empty table gives no rows; other columns are not read, so their names may
    clash. A text of any length is hashed whole, 65,536 shingles at a time.
    """
    kind = StructType([StructField(ROW, LongType()), StructField("id", docs.schema[id].dataType), StructField("fp", LongType())])

    def rows(columns):
        number, ids, texts = columns
        return [number, ids, [f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in texts]]

    prints = cut(map_rows(numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text"), kind, rows))
    # a fingerprint's node is its least row, so that the least node that a node reaches is the answer
    node = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(ROW).alias("row")))
    nodes = cut(prints.groupBy("fp").agg(node.alias("node")))
    # what is joined to edges or rows, of which one fingerprint may have many, is shuffled by itself, so that Spark can split both sides
    ends = links(nodes.select("fp")).join(nodes.withColumnsRenamed({"fp": "u", "node": "a"}), "u").select("a", "v").join(nodes.withColumnsRenamed({"fp": "v", "node": "b"}), "v")
    roots = cut(components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    nodes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")).hint("rebalance")
    return prints.join(nodes, "fp").select(
        ROW, F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("root.id").alias("component_id"), (F.col("root.row") == F.col(ROW)).alias("stays"),
    )
