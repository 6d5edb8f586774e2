"""Risk bands, alert levels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges, labels and colours of the four bands.
BANDS = ((0.0, "Low Risk", "#2ECC71"), (0.3, "Moderate Risk", "#F1C40F"), (0.5, "High Risk", "#E67E22"), (0.7, "Very High Risk", "#E74C3C"))
#: Lower edges of the five older levels 0 to 4.
LEVELS = (0.0, 0.3, 0.6, 0.8, 0.9)


def risk_band(p: Column, bands=BANDS) -> Column:
    """struct(label, colour) of the last band whose lower edge is reached."""
    out = F.lit(None)
    for low, label, colour in bands:
        own = F.struct(F.lit(label).alias("label"), F.lit(colour).alias("colour"))
        out = own if low == bands[0][0] else F.when(p >= low, own).otherwise(out)
    return F.when(p.isNotNull(), out)


def risk_level(p: Column, edges=LEVELS) -> Column:
    """The number of edges, but the first, that are reached."""
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))


def alert(share: Column) -> Column:
    """Alert state by the share of nodes at risk."""
    return F.when(share >= 0.5, "critical").when(share >= 0.15, "warning").otherwise("normal")


def as_percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def as_coordinate(c: Column) -> Column:
    return F.format_string("%.5f", c)


def as_uncertainty(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"+-%.{digits}f", c)
