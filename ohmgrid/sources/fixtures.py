"""A landscape, sites and genotypes derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str, blank_col: int | None = None) -> DataFrame:
    """cell, row, col, size, price, brand; layers are null where cell % 17 = 0 (and in ``blank_col``)."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), "p_size", "p_retailprice", "p_brand")
    p = p.withColumns({"row": F.floor(F.col("cell") / WIDTH), "col": F.col("cell") % WIDTH})
    there = F.col("cell") % 17 != 0
    if blank_col is not None:
        there = there & (F.col("col") != blank_col)
    return p.select("cell", "row", "col", F.when(there, F.col("p_size").cast("double")).alias("size"), F.when(there, F.col("p_retailprice")).alias("price"), F.when(there, F.col("p_brand")).alias("brand"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, cell, bal, nation of all suppliers whose cell is not masked."""
    s = read(spark, sf_dir, "supplier").where((F.col("s_suppkey") * 20 + 3) % 17 != 0)
    return s.select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 20 + 3).alias("cell"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("long").alias("nation"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, grp, feature, value from the vectors."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("unit"), F.col("label").cast("long").alias("grp"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pop, locus, y, n: returned lines among all lines, by nation and part type."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("pop"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("locus"))
    return lines.join(supplier, "l_suppkey").join(part, "l_partkey").groupBy("pop", "locus").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"), F.count("*").alias("n"))


#: The same views in DuckDB's SQL.
RASTER_SQL = f"""
raster AS (SELECT p_partkey AS cell, p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col,
  CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
  CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price,
  CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand FROM part)"""
ACTIVE_SQL = RASTER_SQL + ", active AS (SELECT * FROM raster WHERE size IS NOT NULL AND price IS NOT NULL AND brand IS NOT NULL)"
SITES_SQL = "sites AS (SELECT s_suppkey AS site, s_suppkey * 20 + 3 AS cell, s_acctbal AS bal, CAST(s_nationkey AS BIGINT) AS nation FROM supplier WHERE (s_suppkey * 20 + 3) % 17 <> 0)"
FEATURES_SQL = "features AS (SELECT vec_id AS unit, CAST(label AS BIGINT) AS grp, generate_subscripts(embedding, 1) - 1 AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
COUNTS_SQL = "counts AS (SELECT CAST(s_nationkey AS BIGINT) AS pop, p_type AS locus, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, COUNT(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
