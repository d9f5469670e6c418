"""Views of the tables in the roles that the operators need, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import parts_of


#: Factors that give the tables' short decimals many places, so that nothing lies halfway between two roundings.
TRUTH, PRED, X0 = 1.00031729137, 0.99983172619, 1.00017139271


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast samples: field, lead, start, truth, pred, x0 and weight w."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("lead"), F.col("l_orderkey").alias("start"),
        (F.col("l_extendedprice") * TRUTH).alias("truth"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * PRED).alias("pred"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax")) * X0).alias("x0"), F.col("l_quantity").alias("w"),
    )


SAMPLES = f"""samples AS (SELECT l_returnflag AS field, l_linenumber AS lead, l_orderkey AS start, l_extendedprice * {TRUTH}::DOUBLE AS truth,
    l_extendedprice * (1 - l_discount) * {PRED}::DOUBLE AS pred, l_extendedprice * (1 + l_tax) * {X0}::DOUBLE AS x0, l_quantity AS w FROM lineitem)"""


def lined(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines, columns over a scan, with their order."""
    n = parts_of(lines)
    return lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble members: key, member, value x, beside truth y and weight w of the key, by group; dealt by key into parts that grow with the files."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return lined(lines, orders).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("grp"), F.col("l_linenumber").alias("member"),
        (F.col("l_extendedprice") / 1000 * TRUTH).alias("x"), (F.col("o_totalprice") / 4000 * PRED).alias("y"), F.col("l_quantity").alias("w"),
    )


MEMBERS = f"""members AS (SELECT o_orderkey AS key, o_orderstatus AS grp, l_linenumber AS member, l_extendedprice / 1000 * {TRUTH}::DOUBLE AS x,
    o_totalprice / 4000 * {PRED}::DOUBLE AS y, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gappy daily series: day, cell, feature and the day's mean value."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), "value")
    return events.groupBy("day", "cell", "feature").agg((F.avg("value") * TRUTH).alias("value"))


DAILY = f"daily AS (SELECT CAST(ts AS DATE) AS day, user_id AS cell, event_type AS feature, avg(value) * {TRUTH}::DOUBLE AS value FROM events GROUP BY ALL)"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image 40 cells wide: y, x and value v, its lowest tenth being land (null)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    key = F.col("p_partkey").cast("long")
    return part.select((key / 40).cast("long").alias("y"), (key % 40).alias("x"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("v"))


IMAGE = "image AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, CASE WHEN p_size > 5 THEN p_retailprice END AS v FROM part)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small square fields, one a row: id, label and 64 values by row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


FIELDS = "fields AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

#: (id, y, x, value) of the fields' cells.
CELLS = FIELDS + ", cells AS (SELECT id, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v[i] AS h FROM fields, range(1, 65) t(i))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields' cells: id, label, y, x and height h."""
    rows = fields(spark, sf_dir).select("id", "label", F.posexplode("v").alias("at", "h"))
    return rows.select("id", "label", (F.col("at") / 8).cast("long").alias("y"), (F.col("at") % 8).cast("long").alias("x"), "h")
