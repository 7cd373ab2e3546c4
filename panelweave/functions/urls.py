"""Link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave import fixed

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#\s]+)"


def host(col) -> Column:
    """Lower-case host of a link, with or without a scheme."""
    col = F.col(col) if isinstance(col, str) else col
    found = F.lower(F.regexp_extract(col, _HOST, 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def registered_domain(col, suffixes=fixed.MULTI_SUFFIXES) -> Column:
    """``name.suffix`` of a link; sub-domains are dropped.

    Null for null or failed links, single-label hosts and plain addresses.
    """
    labels = F.split(host(col), r"\.")
    size = F.size(labels)
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    last_three = F.array_join(F.slice(labels, -3, 3), ".")
    numeric = host(col).rlike(r"^[0-9.]+$")
    return (
        F.when(F.coalesce(size, F.lit(0)) < 2, F.lit(None))
        .when(numeric, F.lit(None))
        .when(last_two.isin(list(suffixes)), F.when(size >= 3, last_three))
        .otherwise(last_two)
    )
