"""CSV sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Python names of charsets to the names Spark's writer knows.
_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "cp1251": "windows-1251", "cp1252": "windows-1252"}
_LEGACY = "spark.sql.legacy.javaCharsets"


def write_csv(
    df: DataFrame, folder: str, sep: str = ",", encoding: str = "utf-8", partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Header, no index, doubled quotes, missing cells empty."""
    charset = _CHARSETS.get(encoding.lower(), encoding)
    spark = df.sparkSession
    writer = df.write.mode(mode).options(
        header=True, sep=sep, quote='"', escape='"', nullValue="", emptyValue="", encoding=charset,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not charset.startswith("windows"):
        writer.csv(folder)
        return
    # Spark 4 accepts these charsets only under this setting; put it back afterwards.
    before = spark.conf.get(_LEGACY, None)
    spark.conf.set(_LEGACY, "true")
    try:
        writer.csv(folder)
    finally:
        if before is None:
            spark.conf.unset(_LEGACY)
        else:
            spark.conf.set(_LEGACY, before)
