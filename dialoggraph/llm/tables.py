"""Reading the tables and settings that all operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut  # noqa: F401  (operators cut lineage through this module)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one aggregate, from which table sizes of an operator follow."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"])


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo m: the fold of a row. A null id is in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def picked(rows: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; others may be called alike but for case."""
    inner = [f"_c{k}" for k in range(len(rows.columns))]
    return rows.toDF(*inner).select(*[F.col(inner[rows.columns.index(n)]).alias(n) for n in names])
