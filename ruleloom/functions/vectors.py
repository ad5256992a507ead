"""Vector arithmetic, distances and locality-sensitive hashes over array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def matmul(v: Column, matrix: list[list[float]]) -> Column:
    """A row vector times a literal matrix."""
    return F.array(*[dot(v, F.array(*[F.lit(float(row[j])) for row in matrix])) for j in range(len(matrix[0]))])


def concat(*vs: Column) -> Column:
    return F.concat(*vs)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def centred(a: Column, b: Column) -> Column:
    """Absolute difference of the means."""
    return F.abs(mean(a) - mean(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Places where two bit strings differ."""
    return F.bit_count(F.conv(a, 2, 10).cast("decimal(20,0)").cast("long").bitwiseXOR(F.conv(b, 2, 10).cast("decimal(20,0)").cast("long")))


def planes(bits: int, dim: int, seed: int) -> list[list[float]]:
    """Random hyperplanes with entries in multiples of 1/64, the same everywhere."""
    return [[round(x * 64) / 64 for x in row] for row in np.random.default_rng(seed).normal(size=(bits, dim)).tolist()]


def lsh_bits(v: Column, normals: list[list[float]]) -> Column:
    """A bit string: on which side of each hyperplane the vector lies."""
    return F.concat(*[F.when(dot(v, F.array(*[F.lit(x) for x in p])) >= 0, F.lit("1")).otherwise(F.lit("0")) for p in normals])


def lsh_bucket(v: Column, normals: list[list[float]]) -> Column:
    return F.conv(lsh_bits(v, normals), 2, 10).cast("long")


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)


def one_hot(c: Column, values: list) -> list[Column]:
    return [F.when(c == v, F.lit(1)).otherwise(F.lit(0)).alias(f"is_{v}") for v in values]
