"""Landing: typed rosters, polymorphic contacts, ordered blocks, table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterloom.functions.skew import carry
from rosterloom.functions.text import is_blank

BLOCK_SCHEMA = (
    "doc_id bigint, block_no bigint, block_kind string, heading_level int, "
    "table_no int, row_no int, text string, cells array<string>"
)


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """A file table; CSV and JSON need a schema, so nothing is read to infer one."""
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_roster(
    spark: SparkSession, path: str, schema: StructType | str, key: str, name: str, fmt: str = "parquet", **options
) -> DataFrame:
    """A typed sheet without rows whose key is null or whose name is blank."""
    sheet = read_table(spark, path, schema, fmt, **options)
    return sheet.where(F.col(key).isNotNull() & ~is_blank(F.col(name)))


def attach_contacts(df: DataFrame, key: str, contacts: DataFrame, ref_type: str) -> DataFrame:
    """Contacts of each record, joined on reference type and id.

    Contacts come as rows (contact_id, ref_type, ref_id, contact_type, value) and
    stay rows: (record, contact_type, position, value), so a record with very
    many contacts never becomes one array.  Records without contacts keep one
    row with nulls.
    """
    own = contacts.where(F.col("ref_type") == ref_type).where(~is_blank(F.col("value")))
    placed = carry(own, ["ref_id", "contact_type"], ["contact_id"], number="position")
    placed = placed.select(F.col("ref_id").alias(key), "contact_type", "position", "value")
    bare = df.join(own.select(F.col("ref_id").alias(key)).distinct(), key, "left_anti")
    return placed.join(df, key).unionByName(bare, allowMissingColumns=True)


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Flattened documents: one row per heading, paragraph or table row."""
    return read_table(spark, path, BLOCK_SCHEMA, fmt, **options)


def split_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with its position: a text as ordered blocks."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("pos", "line")).select(
        F.col(id_col), (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """A relational table read in parallel over ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **options)
        .load()
    )
