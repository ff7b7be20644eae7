"""The ratings domain over the driver's star-schema tables, as DataFrames and as SQL text.

Customers are readers, parts are works, an order line is a rating of an edition of a work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Base tables of the domain, read with only the columns that are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def interactions(self) -> DataFrame:
        """user_id, work_id, book_id, rating, added_at, updated_at and read_at (epoch seconds), is_read: one row
        per edition rated."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.unix_timestamp("o_orderdate").alias("added_at"))
        lines = self.read("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_partkey").alias("work_id"),
            (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("book_id"),
            (1 + (F.col("l_quantity").cast("int") + F.col("l_suppkey")) % 5).cast("int").alias("rating"),
            (F.col("l_returnflag") != "A").alias("is_read"),
            F.unix_timestamp("l_shipdate").alias("updated_at"),
            F.when(F.col("l_returnflag") != "A", F.unix_timestamp("l_shipdate") + 604_800).alias("read_at"),
        )
        return lines.join(orders, "o_orderkey").select("user_id", "work_id", "book_id", "rating", "added_at", "updated_at", "read_at", "is_read")

    @property
    def timed(self) -> DataFrame:
        """One row per reader and work: greatest rating, first added and read, last updated."""
        return self.interactions.groupBy("user_id", "work_id").agg(F.max("rating").alias("rating"), F.min("added_at").alias("added_at"), F.max("updated_at").alias("updated_at"), F.min("read_at").alias("read_at"))

    @property
    def works(self) -> DataFrame:
        """work_id, author_id, title, pub_year, is_sf."""
        return self.read("part").select(
            F.col("p_partkey").alias("work_id"),
            (F.col("p_partkey") % 100).alias("author_id"),
            F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 40).cast("string")).alias("title"),
            (1900 + (F.col("p_partkey") * 7) % 120).cast("int").alias("pub_year"),
            F.col("p_type").isin("ECONOMY", "PROMO").alias("is_sf"),
        )

    @property
    def shelves(self) -> DataFrame:
        """work_id, shelf, count: two tags per work."""
        part = self.read("part")
        return part.select(F.col("p_partkey").alias("work_id"), F.lower("p_type").alias("shelf"), F.col("p_size").cast("long").alias("count")).unionByName(
            part.select(F.col("p_partkey").alias("work_id"), F.lower("p_brand").alias("shelf"), (F.col("p_partkey") % 37 + 1).alias("count"))
        )

    @property
    def taste_authors(self) -> DataFrame:
        """author_id, side, prestige: a fixed list of signal authors."""
        a = self.spark.range(100).select(F.col("id").alias("author_id"))
        side = F.when(F.col("author_id") % 10 < 3, "literary_poll").when(F.col("author_id") % 10 == 9, "non_literary")
        return a.select("author_id", side.alias("side"), F.when(F.col("author_id") % 10 < 3, 1.0 - 0.005 * F.col("author_id")).otherwise(F.lit(0.0)).alias("prestige")).filter("side IS NOT NULL")


#: The same tables as common table expressions.
CTE = """
inter AS (
  SELECT o_custkey AS user_id, l_partkey AS work_id, l_partkey * 10 + l_linenumber AS book_id,
    (1 + (l_quantity::INTEGER + l_suppkey) % 5)::INTEGER AS rating, epoch(o_orderdate)::BIGINT AS added_at, l_returnflag <> 'A' AS is_read,
    epoch(l_shipdate)::BIGINT AS updated_at, CASE WHEN l_returnflag <> 'A' THEN epoch(l_shipdate)::BIGINT + 604800 END AS read_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), works AS (
  SELECT p_partkey AS work_id, p_partkey % 100 AS author_id, p_name || ' ' || (p_partkey % 40)::VARCHAR AS title,
    (1900 + (p_partkey * 7) % 120)::INTEGER AS pub_year, p_type IN ('ECONOMY', 'PROMO') AS is_sf FROM part
), shelves AS (
  SELECT p_partkey AS work_id, lower(p_type) AS shelf, p_size::BIGINT AS count FROM part
  UNION ALL SELECT p_partkey, lower(p_brand), p_partkey % 37 + 1 FROM part
), taste_authors AS (
  SELECT a AS author_id, CASE WHEN a % 10 < 3 THEN 'literary_poll' ELSE 'non_literary' END AS side,
    CASE WHEN a % 10 < 3 THEN 1.0::DOUBLE - 0.005::DOUBLE * a ELSE 0.0::DOUBLE END AS prestige
  FROM range(100) t(a) WHERE a % 10 < 3 OR a % 10 = 9
)"""
