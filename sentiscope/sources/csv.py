"""Read the raw product CSV the way the reference's pandas reader sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import NA_TOKENS


def read_product_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Read every column as STRING, keep unknown columns, NA tokens -> NULL.

    ``multiLine`` + ``escape='"'`` are needed for quoted fields with doubled
    quotes and embedded newlines; multi-line CSV cannot be split inside a
    file, so at scale convert the CSV to Parquet once (``tables.write_table``)
    and read that instead.
    """
    df = (spark.read.option("header", True)
          .option("multiLine", multiline)
          .option("escape", '"')
          .csv(path))
    return null_na_tokens(df)


def null_na_tokens(df: DataFrame) -> DataFrame:
    """pandas' default NA tokens become NULL, compared untrimmed (' N/A' is kept)."""
    tokens = [F.lit(t) for t in NA_TOKENS]
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = F.when(~c.isin(*tokens), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_product_id(df: DataFrame) -> DataFrame:
    """S3: the blank-header index column (``_c0``) becomes ``product_id BIGINT``."""
    if "_c0" in df.columns:
        return df.withColumnRenamed("_c0", "product_id").withColumn(
            "product_id", F.col("product_id").try_cast("long"))
    return df


def drop_index(df: DataFrame) -> DataFrame:
    """S3 (training form): drop the index column if present."""
    return df.drop("_c0")
