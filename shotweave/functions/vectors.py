"""Vector expressions: sign codes, Hamming and cosine distance, unit length. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32


def binary_quantize(v: Column) -> Column:
    """One sign bit per dimension (1 if > 0), 32 to a bigint; stored once at load, it replaces the vector in phase one."""
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(WORD)).cast("int") - 1)
    bit = lambda w, i: F.when(F.get(v, w * WORD + i) > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("bigint"), lambda a, i: a * 2 + bit(w, i)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; null when a vector has no length."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def l2_normalize(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(v, v))))


def parse_vector(literal: Column, dims: int) -> Column:
    """An array from '[v, ...]'; an error when the width is wrong."""
    v = F.from_json(literal, "array<double>")
    return F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.concat(F.lit("vector width "), F.size(v).cast("string"))).cast("array<double>"))
