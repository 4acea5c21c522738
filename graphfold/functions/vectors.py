"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def fit_embedding(v: Column, dim: int) -> Column:
    """A vector of exactly dim stays as it is; a longer one is cut and scaled to length 1; a shorter one is an error."""
    head = F.slice(v, 1, dim)
    length = norm(head)
    scaled = F.when(length > 0, F.transform(head, lambda x: x.cast("double") / length)).otherwise(F.transform(head, lambda x: x.cast("double")))
    short = F.raise_error(F.concat(F.lit(f"embedding needs {dim} components, got "), F.size(v).cast("string"))).cast("array<double>")
    return F.when(v.isNull(), F.lit(None).cast("array<double>")).when(F.size(v) < dim, short).when(F.size(v) == dim, F.transform(v, lambda x: x.cast("double"))).otherwise(scaled)
