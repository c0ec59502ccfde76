"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import new_dataset_path


def stash(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` under the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = new_dataset_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def row_hash(frame: DataFrame) -> Column:
    """A hash of all columns, to tell rows apart whose ids are equal or null."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns])


def row_count_parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """Parts of about ``per_part`` rows; one at least."""
    return max(1, -(-rows // per_part))


def packed(frame: DataFrame) -> Column:
    """All columns as one struct ``row``, so that none of their names meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row")


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (doc_id, row_hash) names, each once even where whole rows repeat.

    Both keys take part in the join, so a frequent id (null, say) does not gather in one task; and they are
    plain columns, so the numbering of repeats finds the rows where the join has put them.
    """
    kind = docs.schema["doc_id"].dataType

    def keys(doc_id: Column, hashed: Column) -> list[Column]:
        return [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast(kind)).alias("id"), hashed.alias("hash")]

    names = ["none", "id", "hash"]
    wanted = chosen.select(*keys(F.col("doc_id"), F.col("row_hash"))).distinct()
    joined = docs.select(packed(docs), *keys(F.col("doc_id"), row_hash(docs))).join(wanted, names, "left_semi")
    order = Window.partitionBy(*names).orderBy(F.lit(0))
    return joined.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
