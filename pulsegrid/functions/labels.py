"""Labels as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels in the order in which tables list them.
LABELS = ["burst", "long_burst", "possible_burst", "high_frequency_spiking", "high_frequency_tonic", "tonic", "pause"]
BURST_FAMILY = ["burst", "long_burst", "possible_burst"]


def family(label: Column) -> Column:
    return F.when(label.isin(BURST_FAMILY), "burst_family").otherwise(label)


def promoted(label: Column) -> Column:
    """possible_x becomes x."""
    return F.regexp_replace(label, "^possible_", "")


def clean(label: Column) -> Column:
    """Trimmed and lower-cased; null and none are blank."""
    x = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(x == "none", "").otherwise(x)
