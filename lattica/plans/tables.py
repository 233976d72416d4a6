"""The graph model on TPC-H-like tables: entities are nodes, keys are edges, places in the world are files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import spread

#: Ids are BASE[kind] + key.
BASE = {k: (i + 1) * 10**12 for i, k in enumerate(("region", "nation", "customer", "supplier", "part", "order"))}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("p"))  # 25 rows
    place = F.broadcast(place)
    nations = nation.join(place, "n_nationkey")
    customer = read(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    part, orders = read(spark, d, "part"), read(spark, d, "orders")

    def of(df: DataFrame, kind: str, key: str, label, file, community) -> DataFrame:
        k = F.col(key).cast("long")
        return df.select(
            (k + BASE[kind]).alias("id"), F.concat(F.lit(f"{kind}:"), k).alias("slug"), label.alias("label"), F.lower(label).alias("norm_label"), F.lit(kind).alias("kind"), F.lit("code").alias("file_type"),
            file.alias("source_file"), F.concat(F.lit("L"), k % 1000 + 1).alias("source_location"), community.cast("int").alias("community"), F.lit("ast").alias("origin"),
        )

    parts = [
        of(region, "region", "r_regionkey", F.col("r_name"), F.concat("r_name", F.lit("/region")), F.col("r_regionkey") + 100),
        of(nations, "nation", "n_nationkey", F.col("n_name"), F.concat("p", F.lit("/nation")), F.col("n_nationkey")),
        of(customer, "customer", "c_custkey", F.col("c_name"), F.concat("p", F.lit("/customer")), F.col("c_nationkey")),
        of(supplier, "supplier", "s_suppkey", F.col("s_name"), F.concat("p", F.lit("/supplier")), F.col("s_nationkey")),
        of(part, "part", "p_partkey", F.col("p_name"), F.concat(F.lit("parts/"), "p_brand", F.lit("/part")), F.col("p_size") + 200),
        of(orders, "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/order")), F.pmod("o_custkey", F.lit(25)) + 300),
    ]
    return reduce(DataFrame.unionByName, parts)


def edge_rows(spark: SparkSession, d: str) -> int:
    """At least as many as there are edges, from what the files say of their rows."""
    rows = {t: read(spark, d, t).count() for t in ("nation", "customer", "supplier", "orders", "lineitem")}
    return sum(rows.values()) + rows["lineitem"]


def edges(spark: SparkSession, d: str) -> DataFrame:
    lineitem = read(spark, d, "lineitem")
    rows = lineitem.count()
    # The least flag counts. It is needed only as A, R or neither, so a number that has its order stands for it: that is aggregated by hash.
    flag = F.col("l_returnflag")
    order = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "R", 2).when(flag == "R", 3).otherwise(4)
    by_flag = F.when(F.col("f") == 1, "AMBIGUOUS").when(F.col("f") == 3, "INFERRED").otherwise("EXTRACTED")

    def of(df: DataFrame, n: int, a: str, src: str, b: str, dst: str, relation: str, confidence=None) -> DataFrame:
        x, y = F.col(src).cast("long"), F.col(dst).cast("long")
        return df.select(
            (F.lit(n * 10**16) + x * 10**8 + y).alias("id"), (x + BASE[a]).alias("src"), (y + BASE[b]).alias("dst"), F.lit(relation).alias("relation"),
            (F.lit("EXTRACTED") if confidence is None else confidence).alias("confidence"), F.lit(a).alias("source_file"), F.concat(F.lit("L"), x).alias("source_location"),
        )

    order_part = spread(lineitem.select("l_orderkey", "l_partkey", order.alias("f")), rows, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.min("f").alias("f"))
    part_supplier = spread(lineitem.select("l_partkey", "l_suppkey"), rows, "l_partkey", "l_suppkey").distinct()
    parts = [
        of(read(spark, d, "nation"), 0, "region", "n_regionkey", "nation", "n_nationkey", "contains"),
        of(read(spark, d, "customer"), 1, "nation", "c_nationkey", "customer", "c_custkey", "contains"),
        of(read(spark, d, "supplier"), 2, "nation", "s_nationkey", "supplier", "s_suppkey", "contains"),
        of(read(spark, d, "orders"), 3, "customer", "o_custkey", "order", "o_orderkey", "calls"),
        of(order_part, 4, "order", "l_orderkey", "part", "l_partkey", "references", by_flag),
        of(part_supplier, 5, "part", "l_partkey", "supplier", "l_suppkey", "calls"),
    ]
    return reduce(DataFrame.unionByName, parts)


GRAPH_SQL = """place AS (
  SELECT n_nationkey, r_name || '/' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey
), nodes AS (
  SELECT 1000000000000 + r_regionkey AS id, 'region:' || r_regionkey AS slug, r_name AS label, 'region' AS kind, r_name || '/region' AS source_file, r_regionkey % 1000 + 1 AS line, r_regionkey + 100 AS community FROM region
  UNION ALL SELECT 2000000000000 + n.n_nationkey, 'nation:' || n.n_nationkey, n_name, 'nation', p || '/nation', n.n_nationkey % 1000 + 1, n.n_nationkey FROM nation n JOIN place ON n.n_nationkey = place.n_nationkey
  UNION ALL SELECT 3000000000000 + c_custkey, 'customer:' || c_custkey, c_name, 'customer', p || '/customer', c_custkey % 1000 + 1, c_nationkey FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000 + s_suppkey, 'supplier:' || s_suppkey, s_name, 'supplier', p || '/supplier', s_suppkey % 1000 + 1, s_nationkey FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 5000000000000 + p_partkey, 'part:' || p_partkey, p_name, 'part', 'parts/' || p_brand || '/part', p_partkey % 1000 + 1, p_size + 200 FROM part
  UNION ALL SELECT 6000000000000 + o_orderkey, 'order:' || o_orderkey, 'order ' || o_orderkey, 'order', 'orders/' || o_orderpriority || '/order', o_orderkey % 1000 + 1, o_custkey % 25 + 300 FROM orders
), edges AS (
  SELECT CAST(n_regionkey AS BIGINT) * 100000000 + n_nationkey AS id, 1000000000000 + n_regionkey AS src, 2000000000000 + n_nationkey AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence FROM nation
  UNION ALL SELECT 10000000000000000 + CAST(c_nationkey AS BIGINT) * 100000000 + c_custkey, 2000000000000 + c_nationkey, 3000000000000 + c_custkey, 'contains', 'EXTRACTED' FROM customer
  UNION ALL SELECT 20000000000000000 + CAST(s_nationkey AS BIGINT) * 100000000 + s_suppkey, 2000000000000 + s_nationkey, 4000000000000 + s_suppkey, 'contains', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 30000000000000000 + o_custkey * 100000000 + o_orderkey, 3000000000000 + o_custkey, 6000000000000 + o_orderkey, 'calls', 'EXTRACTED' FROM orders
  UNION ALL SELECT 40000000000000000 + l_orderkey * 100000000 + l_partkey, 6000000000000 + l_orderkey, 5000000000000 + l_partkey, 'references',
    CASE min(l_returnflag) WHEN 'A' THEN 'AMBIGUOUS' WHEN 'R' THEN 'INFERRED' ELSE 'EXTRACTED' END FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 50000000000000000 + l_partkey * 100000000 + l_suppkey, 5000000000000 + l_partkey, 4000000000000 + l_suppkey, 'calls', 'EXTRACTED' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
), ends AS (
  SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst
), counted AS (SELECT id, count(*) AS d FROM ends GROUP BY id), degrees AS (
  SELECT n.id, coalesce(d, 0) AS degree FROM nodes n LEFT JOIN counted c ON n.id = c.id
)"""
