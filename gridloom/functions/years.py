"""Years in file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a year in a name looks like.
YEAR = r"(?:19|20)[0-9]{2}"


def year_in(c: Column) -> Column:
    """The first year in a name, else NULL."""
    return F.nullif(F.regexp_extract(c, YEAR, 0), F.lit("")).try_cast("int")


def year_in_name(name: str) -> int | None:
    found = re.search(YEAR, name)
    return int(found.group(0)) if found else None
