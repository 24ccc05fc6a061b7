"""Content-addressed ids, hash uniforms, buckets and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of the serialised form of a context. Fixed values.
CONTRACT, RECORD, FIELD, NULL = "data-contract-v1", "\x1e", "\x1f", "<NULL>"


def context_id(fields: Sequence[str]) -> Column:
    """SHA-256 of the named fields, in the order given."""
    body = F.concat_ws(FIELD, *(F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(NULL))) for f in fields))
    return F.sha2(F.concat(F.lit(CONTRACT + RECORD), body), 256)


def hash_number(key: Column) -> Column:
    """The first eight bytes of the key's SHA-256 as an unsigned number, decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_uniform(key: Column) -> Column:
    """In [0, 1)."""
    return hash_number(key).cast("double") / F.lit(2.0**64)


def hash_bucket(key: Column, n: int) -> Column:
    return F.pmod(hash_number(key), F.lit(n).cast("decimal(20,0)")).cast("int")


def hash_split(key: Column, proportions: Sequence[float] = (0.8, 0.1, 0.1), names: Sequence[str] = ("train", "validation", "test")) -> Column:
    """The name whose share of [0, 1) the key's uniform falls in."""
    u = hash_uniform(key)
    out, top = None, 0.0
    for name, p in zip(names[:-1], proportions, strict=False):
        top += p
        out = F.when(u < top, F.lit(name)) if out is None else out.when(u < top, F.lit(name))
    return out.otherwise(F.lit(names[-1])) if out is not None else F.lit(names[-1])


def table_fingerprint(columns: Sequence[str]) -> Column:
    """An aggregate that is the same for the same rows in any order."""
    return F.sum(F.xxhash64(F.struct(*columns)).cast("decimal(38,0)")).cast("string")
