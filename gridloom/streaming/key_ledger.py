"""Deduplication that remembers: a row is new if its key is in none of the files that came before.

The rows kept are the memory. Each portion of rows (a micro-batch, or one batch run)
is written to a folder of its own together with its keys, so rows and memory are one
commit. A portion that is done again, after a crash or by a restart, is held against
the portions before it only, and takes the place of what it wrote the first time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.names import col
from gridloom.functions.text import norm_key
from gridloom.operators.columns import resolve_column
from gridloom.sources.csv_files import ORD
from gridloom.sources.files import read_if_there

KEY = "_key"
PORTION = "_portion"


class KeyLedger:
    """Rows by first appearance of their key, under ``folder``.

    Keys are the cells of ``keys`` as :func:`gridloom.operators.dedup.dedup_by_key`
    compares them. Within a portion the first row by ``_ord`` is kept.
    """

    def __init__(self, folder: str, keys: Sequence[str], upper: bool = True, drop_spaces: bool = False, drop_dashes: bool = False):
        self.folder, self.keys = folder.rstrip("/"), list(keys)
        self._fold = (upper, True, drop_spaces, drop_dashes)

    def _portions(self, spark: SparkSession) -> DataFrame | None:
        return read_if_there(spark, self.folder)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows kept so far, each key once."""
        found = self._portions(spark)
        if found is None:
            raise ValueError(f"nothing has been added under {self.folder}")
        return found.drop(KEY, PORTION)

    def add(self, rows: DataFrame, portion: int) -> None:
        """Keep the rows of ``portion`` whose keys no earlier portion has. Portions are numbered upwards.

        A key that holds any share of the rows leaves each task as one row. The keys
        seen before are scanned where they lie (one column) and matched with the new
        ones: Spark broadcasts the new ones while they are few, and shuffles both beyond.
        """
        names = [resolve_column(rows.columns, k) for k in self.keys]
        # An array keeps cells apart; as JSON it is one text.
        key = F.to_json(F.array(*[norm_key(F.coalesce(col(n).cast("string"), F.lit("")), *self._fold) for n in names]))
        order = Window.partitionBy(KEY).orderBy(col(ORD))
        first = rows.withColumn(KEY, key).withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", ORD)
        known = self._portions(rows.sparkSession)
        if known is not None:
            known = known.where(F.col(PORTION) < portion).select(KEY)
            first = first.join(known, KEY, "left_anti")
        first.write.mode("overwrite").parquet(f"{self.folder}/{PORTION}={portion}")


def unify_stream(arriving: DataFrame, ledger: KeyLedger, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows of arriving files (with ``_ord``) whose keys no earlier file has, kept in ``ledger``. A restart goes on where it was."""
    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: ledger.add(rows, batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
