"""Numbers as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, rounded on the exact value as printf does, without thousands marks."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))
