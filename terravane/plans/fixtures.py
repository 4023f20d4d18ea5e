"""Geometry derived from the driver's tables, and the same definitions as SQL CTEs.

Coordinates are integers wherever possible, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as points: price in cents, customer, key modulo 97; the customer is the object."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS vertex_id", "o_custkey AS object_id", "cast(round(o_totalprice * 100) AS bigint) AS x", "o_custkey AS y", "o_orderkey % 97 AS z"
    )


P = """p AS (SELECT o_orderkey AS vertex_id, o_custkey AS object_id, CAST(round(o_totalprice * 100) AS BIGINT) AS x,
        o_custkey AS y, o_orderkey % 97 AS z FROM orders)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user in time order as a path: value in cents, event, length of its type."""
    e = table(spark, sf, "events").selectExpr(
        "user_id AS object_id", "event_id AS vertex_id", "ts", "cast(round(value * 100) AS bigint) AS x", "event_id AS y", "cast(length(event_type) AS bigint) AS z"
    )
    return e.withColumn("seq", F.expr("row_number() OVER (PARTITION BY object_id ORDER BY ts, vertex_id) - 1").cast("long")).drop("ts")


L = """l AS (SELECT user_id AS object_id, event_id AS vertex_id, CAST(round(value * 100) AS BIGINT) AS x, event_id AS y,
        CAST(length(event_type) AS BIGINT) AS z,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive orders join their customers, over all orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("v1"))
    both = o.join(nxt, "o_orderkey").where("o_custkey <> v1")
    return both.selectExpr("o_orderkey AS edge_id", "o_custkey AS v0", "v1", "1 + cast(round(o_totalprice * 100) AS bigint) % 100 AS weight")


E = """e AS (SELECT a.o_orderkey AS edge_id, a.o_custkey AS v0, b.o_custkey AS v1,
        1 + CAST(round(a.o_totalprice * 100) AS BIGINT) % 100 AS weight
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
        ee AS (SELECT v0 AS a, v1 AS b, weight AS w FROM e UNION ALL SELECT v1, v0, weight FROM e)"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS vertex_id")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a tree; positions are key, size and key modulo 13."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS vertex_id",
        "CASE WHEN p_partkey = 0 THEN -1L ELSE cast(floor((p_partkey - 1) / cast(1 + p_size % 4 AS double)) AS bigint) END AS parent",
        "p_partkey AS x", "cast(p_size AS bigint) AS y", "p_partkey % 13 AS z", "cast(round(p_retailprice * 100) AS bigint) AS radius",
    )


T = """t AS (SELECT p_partkey AS vertex_id,
        CASE WHEN p_partkey = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor((p_partkey - 1) / CAST(1 + p_size % 4 AS DOUBLE)) AS BIGINT) END AS parent,
        p_partkey AS x, CAST(p_size AS BIGINT) AS y, p_partkey % 13 AS z, CAST(round(p_retailprice * 100) AS BIGINT) AS radius FROM part)"""


def mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts on a square grid with their size as height; two triangles per grid cell;
    a face's object is its row modulo 5."""
    part = table(spark, sf, "part")
    side = int(part.count() ** 0.5)
    v = part.where(f"p_partkey < {side * side}").selectExpr(
        "p_partkey AS vertex_id", f"p_partkey div {side} AS x", f"p_partkey % {side} AS y", "cast(p_size AS bigint) AS z"
    )
    cell = v.where(f"x < {side - 1} AND y < {side - 1}").selectExpr("vertex_id AS k", "x AS row")
    faces = cell.selectExpr(
        f"inline(array(struct(2 * k AS face_id, k AS v0, k + 1 AS v1, k + {side} AS v2, row % 5 AS object_id),"
        f"struct(2 * k + 1 AS face_id, k + 1 AS v0, k + {side} + 1 AS v1, k + {side} AS v2, row % 5 AS object_id)))"
    )
    return v, faces


M = """s AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part),
        v AS (SELECT p_partkey AS vertex_id, p_partkey // s.n AS x, p_partkey % s.n AS y, CAST(p_size AS BIGINT) AS z FROM part, s WHERE p_partkey < s.n * s.n),
        f AS (SELECT 2 * vertex_id + h AS face_id, vertex_id + h AS v0,
                     CASE h WHEN 0 THEN vertex_id + 1 ELSE vertex_id + s.n + 1 END AS v1, vertex_id + s.n AS v2, x % 5 AS object_id
              FROM v, s, (VALUES (0), (1)) AS t(h) WHERE x < s.n - 1 AND y < s.n - 1),
        fc AS (SELECT f.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2,
                 (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz
               FROM f JOIN v a ON a.vertex_id = v0 JOIN v b ON b.vertex_id = v1 JOIN v c ON c.vertex_id = v2)"""
