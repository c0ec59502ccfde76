"""Sheets as datasets: capped sheets of a split table, and new sheets beside existing ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import col, free_name
from gridloom.operators.ordering import ORD
from gridloom.sinks.csv_files import write_csv
from gridloom.sources.files import _store, claim, qualified


def export_sheets(df: DataFrame, folder: str, fmt: str = "parquet", drop: Sequence[str] = (ORD,), force_text: Sequence[str] = ()) -> None:
    """Write a table with ``sheet`` and ``sheet_row`` columns, one file per sheet.

    A sheet is capped, so one task per sheet is a bounded share of work.
    ``workbook`` puts the sheets a task holds into one workbook.
    """
    text = [col(c).cast("string").alias(c) if c in force_text else col(c) for c in df.columns if c not in drop]
    placed = df.select(*text).repartition("sheet").sortWithinPartitions("sheet", "sheet_row")
    placed = placed.drop("sheet_row", "sheet_no")
    if fmt == "workbook":
        from gridloom.sources.workbook import register

        register(df.sparkSession)
        placed.write.format("workbook").mode("append").option("sheet_column", "sheet").option(
            "path", qualified(df.sparkSession, folder)
        ).save()
    elif fmt == "csv":
        write_csv(placed, folder, partition_by=["sheet"])
    else:
        placed.write.format(fmt).partitionBy("sheet").save(folder)


def sheet_names(folder: str) -> list[str]:
    """Sheets a dataset folder already has."""
    from pyarrow import fs

    store, inner = _store(folder)
    entries = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(unquote(e.base_name[6:]) for e in entries if e.base_name.startswith("sheet="))


def append_sheet(df: DataFrame, folder: str, base: str = "UNIQUE", fmt: str = "parquet") -> str:
    """Write a new sheet beside the existing ones under a free name, which is returned. Nothing is overwritten.

    Any number of writers may append at once: a name is claimed, which one of them
    alone can do, before anything is written, and each sheet is a job with an output
    folder of its own. A name whose writer fails stays claimed and is not given again.
    """
    spark, where = df.sparkSession, qualified(df.sparkSession, folder).rstrip("/")
    taken = set(sheet_names(where))
    while True:
        name = free_name(taken, base)
        if claim(spark, f"{where}/_claimed/{_escaped(name)}"):
            df.write.mode("errorifexists").format(fmt).save(f"{where}/sheet={_escaped(name)}")
            return name
        taken.add(name)


def _escaped(name: str) -> str:
    """A name as Spark writes it in a partition's folder."""
    return re.sub(r'[\x00-\x1f"#%\'*/:=?\\\x7f{\[\]^]', lambda c: f"%{ord(c.group()):02X}", name)


def write_blocks(stacked: DataFrame, folder: str, sheet: str = "SUMMARY") -> None:
    """The stacked summary sheet as workbooks. The global sort puts consecutive rows in consecutive
    tasks, so the files in name order hold the report in order; a small one is a single file."""
    from gridloom.sources.workbook import register

    register(stacked.sparkSession)
    ordered = stacked.orderBy("block_no", "part", col("cnt").desc_nulls_last(), "a").select("a", "b")
    target = qualified(stacked.sparkSession, folder)
    ordered.write.format("workbook").mode("append").option("sheet", sheet).option("path", target).save()


def read_appended(spark: SparkSession, folder: str, sheet: str) -> DataFrame:
    return spark.read.parquet(folder).where(col("sheet") == sheet).drop("sheet")
