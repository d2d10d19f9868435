"""Result folders, scenario files and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Paths in a folder, through Hadoop, so that any store Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def all_results(spark: SparkSession, folder: str) -> DataFrame:
    """The one Parquet file or folder whose name has AllResults; none or several is an error."""
    found = [p for p in listing(spark, folder) if "AllResults" in p.rsplit("/", 1)[1]]
    if len(found) != 1:
        raise ValueError(f"expected one AllResults, found {len(found)}")
    return spark.read.parquet(found[0])


def match_model(names: list[str], model: str, synonyms: dict[str, str] | None = None) -> str:
    """The one name that contains the model's name or its synonym, as plain text."""
    wanted = {model, (synonyms or {}).get(model, model)}
    found = [n for n in names if any(w in n for w in wanted)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files match {model}")
    return found[0]


def matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """i, j, value of a square CSV without a header.

    A matrix file is small and one file; it is read as one partition to keep its order.
    """
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: x != "")).alias("i", "line"))
    return lines.select("i", F.posexplode(F.split("line", ",")).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("value"))


def scenario(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a simulated scenario: dims, theta, focal, and the matrices where present."""
    have = {p.rsplit("/", 1)[1]: p for p in listing(spark, folder)}
    out = {}
    for name, file in (("dims", "dims.csv"), ("theta", "theta_true.csv"), ("focal", "focal_cell.csv")):
        if file in have:
            schema = "nx long, ny long, nu double" if name == "dims" else "col long, row long" if name == "focal" else None
            out[name] = spark.read.csv(have[file], header=True, schema=schema, inferSchema=schema is None)
    for name, file in (("covariance", "COV.csv"), ("distance", "S.csv")):
        if file in have:
            out[name] = matrix_csv(spark, have[file])
    return out


def write_parameters(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_raster(df: DataFrame, path: str, tile: int = 1024) -> None:
    """A raster as Parquet, in a folder per tile of rows and columns, so that crops prune files."""
    tiled = df.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    tiled.write.mode("overwrite").partitionBy("tr", "tc").parquet(path)
