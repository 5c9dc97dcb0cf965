"""Address presence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.schema import ADDRESS_COLUMNS


def address_is_missing() -> Column:
    """All address columns are null; one value makes the address present."""
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in ADDRESS_COLUMNS])
