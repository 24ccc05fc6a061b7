"""Geographic and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector is an error."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.raise_error(F.lit("zero vector")).cast("array<double>"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clipped_log_share(n: Column, total: Column) -> Column:
    """ln(1 + n) / ln(1 + total), in [0.1, 1]."""
    return clip(F.log1p(n) / F.log1p(total), 0.1, 1.0)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))


def margin(p: Column) -> Column:
    """The greatest probability less the second; of one alone, itself."""
    sorted_p = F.sort_array(p, asc=False)
    return F.element_at(sorted_p, 1) - F.coalesce(F.try_element_at(sorted_p, F.lit(2)), F.lit(0.0))


def score(c: Column) -> Column:
    """Scores are rounded before they rank, so that sums in another order can't turn a tie."""
    return F.round(c, 9)
