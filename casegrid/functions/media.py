"""Facts about media that come as columns: perceptual hashes of pixels, and tags and sentences about detected objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Classes of objects and the tags they give, the general one first.
TAGS = {
    ("knife", "gun", "rifle", "pistol", "weapon"): ("weapon_detected", "weapon_"), ("car", "truck", "motorcycle", "bus", "van"): ("vehicle_detected", "vehicle_"),
    ("person", "people"): ("person_detected", None), ("backpack", "suitcase", "handbag"): ("suspicious_item", "item_"),
}


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal matrix of the discrete cosine transform of length n."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    basis[0] /= np.sqrt(2.0)
    return basis


def shrunk(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Grey values on a grid of rows x columns, by bilinear interpolation between pixel centres."""
    out = pixels.astype(float)
    for axis, n in ((0, rows), (1, columns)):
        size = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, size - 1), axis) * part
    return out


def hash_of(pixels: np.ndarray, size: int = 8) -> str:
    """Hexadecimal perceptual hash: the signs, against their median, of the lowest size x size cosine coefficients of the shrunk picture."""
    small = shrunk(pixels, size, size + 1)
    low = (cosine_basis(size) @ small @ cosine_basis(size + 1).T)[:size, :size]
    bits = "".join("1" if b else "0" for b in (low > np.median(low)).ravel())
    return f"{int(bits, 2):0{size * size // 4}x}"


@F.pandas_udf(StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """Hash of grey pictures given as arrays of rows; null for null, empty and ragged ones."""

    def one(rows) -> str | None:
        if rows is None or not len(rows) or not len(rows[0]) or len({len(r) for r in rows}) > 1:
            return None
        return hash_of(np.array([np.asarray(r, dtype=float) for r in rows]))

    return pixels.map(one)


def hash_distance(a: Column, b: Column) -> Column:
    """Number of different bits of two hashes of 64 bits; null if either is none."""
    halves = lambda c: [F.conv(F.substring(c, i, 8), 16, 10).try_cast("long") for i in (1, 9)]
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(halves(a), halves(b))), F.lit(0))


def tags(classes: Column) -> Column:
    """Sorted distinct tags of an array of detected classes; empty for null."""
    low = F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.lower(c))
    found = []
    for names, (general, prefix) in TAGS.items():
        own = F.array_intersect(low, F.array(*map(F.lit, names)))
        found.append(F.when(F.size(own) > 0, F.array(F.lit(general))).otherwise(F.array().cast("array<string>")))
        if prefix:
            found.append(_prefixed(prefix, own))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda c: F.concat(F.lit(prefix), c))


def description(classes: Column) -> Column:
    """A sentence on an array of detected classes: each with its number, the most frequent first, ties by name."""
    low = F.array_sort(F.coalesce(classes, F.array().cast("array<string>")))
    each = F.transform(F.array_distinct(low), lambda c: F.struct((-F.size(F.filter(low, lambda x: x == c))).alias("n"), c.alias("c")))
    parts = F.transform(F.array_sort(each), lambda e: F.when(e["n"] == -1, F.concat(F.lit("one "), e["c"])).otherwise(F.concat((-e["n"]).cast("string"), F.lit(" "), e["c"], F.lit("s"))))
    n = F.size(parts)
    many = F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(parts, -1))
    said = F.when(n == 1, F.get(parts, F.lit(0))).when(n == 2, F.array_join(parts, " and ")).otherwise(many)
    return F.when(n == 0, "No objects detected in this image.").otherwise(F.concat(F.lit("This image contains "), said, F.lit(".")))
