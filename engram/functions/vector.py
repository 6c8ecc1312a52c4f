"""Distances between vectors in array columns, as expressions; double precision throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _zip(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def inner_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: (x - y) * (x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 0 between two zero vectors, 1 if one is zero."""
    p, q = dot(a, a), dot(b, b)
    return F.when((p == 0) & (q == 0), F.lit(0.0)).when((p == 0) | (q == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / (F.sqrt(p) * F.sqrt(q)))


def cosine(a: Column, b: Column) -> Column:
    return 1 - cosine_distance(a, b)


def pearson_distance(a: Column, b: Column) -> Column:
    n = F.size(a)
    ma, mb = _sum(F.transform(a, lambda x: x.cast("double"))) / n, _sum(F.transform(b, lambda x: x.cast("double"))) / n
    return 1 - _zip(a, b, lambda x, y: (x - ma) * (y - mb)) / F.sqrt(_zip(a, a, lambda x, y: (x - ma) * (y - ma)) * _zip(b, b, lambda x, y: (x - mb) * (y - mb)))


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of two distributions."""
    part = lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0) / 2
    return _zip(a, b, lambda x, y: part(x, y) + part(y, x))


def haversine_meters(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance between places in degrees."""
    lat_a, lon_a, lat_b, lon_b = map(F.radians, (lat_a, lon_a, lat_b, lon_b))
    h = F.pow(F.sin((lat_b - lat_a) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lon_b - lon_a) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard_bits(a: Column, b: Column) -> Column:
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - F.bit_count(a.bitwiseAND(b)) / either)


def sorensen_bits(a: Column, b: Column) -> Column:
    total = F.bit_count(a) + F.bit_count(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - 2 * F.bit_count(a.bitwiseAND(b)) / total)


def jaccard_sets(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / either)


def hamming_unicode(a: Column, b: Column) -> Column:
    """Characters that differ, place by place; those beyond the shorter text differ."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True))), lambda d: d))


def to_i8(vector: Column) -> Column:
    """Components from -1 to 1 as integers from -127 to 127."""
    return F.transform(vector, lambda x: F.round(x * 127).cast("tinyint"))


def from_i8(vector: Column) -> Column:
    """The components that integers from -127 to 127 stand for."""
    return F.transform(vector, lambda x: (x / 127).cast("float"))


def to_bits(vector: Column) -> Column:
    """One bit a component, set above zero: 64 to a long, the first in the lowest; ``hamming_words`` compares them."""
    words = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int"))
    bit = lambda part: F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.transform(words, lambda w: F.aggregate(bit(F.slice(vector, w * 64 + 1, 64)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def hamming_words(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of longs of the same size."""
    return F.aggregate(F.zip_with(a, b, hamming_bits), F.lit(0), lambda n, x: n + x)


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """Deterministic unit vectors of hashed words, where no model is at hand: one count a word, by its hash."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, 8192)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, counts).otherwise(F.transform(counts, lambda x: x / norm)).cast("array<float>")


DISTANCES = {"cosine": cosine_distance, "inner": inner_distance, "sqeuclidean": squared_distance, "pearson": pearson_distance, "divergence": divergence}
