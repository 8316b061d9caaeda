"""Tables, JSON files and pages as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_map(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """A file with one object of lists: key → rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(row)))).alias("key", "rows")).select("key", F.explode("rows").alias("r")).select("key", "r.*")


def or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A snapshot, or no rows where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new snapshot directory; readers switch by name, so nothing is overwritten while it is read."""
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    return f"{root}/{name}"


def blocks(html: Column, start: str, longest: int = 20_000) -> Column:
    """The page cut at each match of start; what stands before the first is dropped, the last block has `longest` characters at most."""
    cut = F.split(F.regexp_replace(html, f"({start})", "\u0001$1"), "\u0001")

    def trimmed(both):
        rows = F.transform(both["cut"], lambda b, i: F.when(i == both["n"] - 1, F.substring(b, 1, longest)).otherwise(b))
        return F.slice(rows, F.lit(2), F.greatest(both["n"] - 1, F.lit(0)))

    return let(let(cut, lambda c: F.struct(c.alias("cut"), F.size(c).alias("n"))), trimmed)


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first capture, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def wrapper(pages: DataFrame, html: str, start: str, spec: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per block, with a capture per field of the spec."""
    rows = pages.select(*keep, F.posexplode(blocks(F.col(html), start)).alias("pos", "block"))
    return rows.select(*keep, "pos", *[first(F.col("block"), p).alias(c) for c, p in spec.items()])
