"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected equally often: the source's target over
its size. The expected copies are summed along the source, one random offset is
added, and a document is emitted once for each integer that its step crosses. The
documents lie in order of size, so the words taken stay within about the largest
document of the target.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._positions import cells, dealt, positions
from ._shared import ROW, cut, numbered

WEIGHTS, MOST, WORD = (5, 2, 1), 3, r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what is cut off is shared again."""
    out, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while active:
        total = sum(weights[i] for i in active)
        full = {i for i in active if left * weights[i] / total > most * sizes[i]}
        for i in full or active:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        active -= full
    return out


def offset(seed: int, source: str | None) -> float:
    """A number in [0, 1) for a source, the same for the same seed."""
    return int(md5(f"{seed}:{source}".encode() if source is not None else str(seed).encode()).hexdigest()[:13], 16) / 2**52


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """For each row of ``docs``: its row number, id, size in words, source_size, target, copies and taken.

    Sources are ordered by code point, null last, and weigh ``weights``,
    repeating. Null texts have size 0 and take nothing, however often they are
    drawn; a source without words has target 0. Ids may be null or repeat. An
    empty table gives no rows; other columns are not read, so their names may
    clash. Texts of any length are counted whole. Documents of one size lie in the
    order of their ids, then of their rows. The same table and seed give the same
    copies. The driver holds one row for each source, as it does the weights.
    """
    rows = numbered(docs, F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(rows.select(ROW, "id", "source", size.alias("size")))
    found = sorted(rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([r[1] for r in found], [weights[k % len(weights)] for k in range(len(found))], most)
    plan = [(k, r[0], r[1], goal, goal / r[1] if r[1] else 0.0, offset(seed, r[0])) for k, (r, goal) in enumerate(zip(found, goals, strict=True))]
    plan = docs.sparkSession.createDataFrame(plan, "sid int, name string, source_size long, target double, each double, offset double")
    # strata of sizes within a sixteenth, each dealt into cells by id
    bits = F.length(F.bin("size")).cast("int")
    stratum = F.when(F.col("size") < 32, F.col("size")).otherwise(bits * 16 + F.expr("shiftright(size, CAST(length(bin(size)) AS INT) - 5) & 15"))
    rows = dealt(rows, "id", ROW, cells(sum(r[2] for r in found)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("stratum", stratum)
    rows = positions(rows, ["sid"], ["stratum", "cell"], [F.col("size"), F.col("id").asc_nulls_last(), F.col(ROW)], "at")
    copies = (F.floor((F.col("at") + 1) * F.col("each") + F.col("offset")) - F.floor(F.col("at") * F.col("each") + F.col("offset"))).cast("long")
    return rows.withColumn("copies", copies).select(ROW, F.col("id").alias(id), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
