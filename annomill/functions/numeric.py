"""Column functions on numbers, boxes and hashes. Boxes are columns x, y, w, h."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + k) for k in ("x", "y", "w", "h")))

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    def contains(self, x: Column, y: Column, pad: Column | float = 0.0) -> Column:
        return x.between(self.x - pad, self.x + self.w + pad) & y.between(self.y - pad, self.y + self.h + pad)


def overlap(a: Box, b: Box, pad: float = 0.0) -> Column:
    """Area in common, after padding both boxes on all sides."""
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x) + 2 * pad)
    return across * F.greatest(zero, F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y) + 2 * pad)


def iou(a: Box, b: Box, pad: float = 2.0) -> Column:
    """Intersection over union of padded boxes; 0 where the union is empty."""
    size = lambda k: (k.w + 2 * pad) * (k.h + 2 * pad)
    both = overlap(a, b, pad)
    union = size(a) + size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def covered_by(a: Box, b: Box) -> Column:
    """Share of a inside b; for a box without area 1 if both its corners lie inside, else 0."""
    inside = b.contains(a.x, a.y) & b.contains(a.x + a.w, a.y + a.h)
    return F.when(a.area > 0, overlap(a, b) / a.area).otherwise(F.when(inside, 1.0).otherwise(0.0))


def dist_to_box(x: Column, y: Column, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.hypot(F.greatest(b.x - x, zero, x - b.x - b.w), F.greatest(b.y - y, zero, y - b.y - b.h))


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def half_even(v: Column, digits: int = 0) -> Column:
    return F.bround(v, digits)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def percent(v: Column, origin: Column, extent: Column) -> Column:
    """Place within an extent, in whole percent."""
    return half_up(100 * (v - origin) / extent)


def softmax(values: Column) -> Column:
    """Stable softmax of an array."""
    e = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of the closed polygon through the points."""
    n = F.size(xs)
    turn = lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i)
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + turn(i))) / 2)


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """The point under x' = ax + by + c, y' = dx + ey + f."""
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def homography(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """The point under a 3 x 3 matrix given by rows."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def hash32(s: Column) -> Column:
    """The first eight hex digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(s), 1, 8), 16, 10).cast("long")


def hash_bucket(s: Column, n: int = 100) -> Column:
    """The same bucket in every run, on every machine."""
    return hash32(s) % n


def uniform(seed: str, *key: Column | str) -> Column:
    """A draw from 0 to under 1 that depends on the seed and the row's key alone."""
    return hash32(F.concat_ws(":", F.lit(seed), *(k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key))) / float(1 << 32)


def gauss(seed: str, *key: Column | str) -> Column:
    """A standard normal draw (Box-Muller on two uniform ones)."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed + "/r", *key))) * F.cos(2 * F.pi() * uniform(seed + "/a", *key))


def poisson(rate: float, u: Column) -> Column:
    """The inverse Poisson distribution function of a uniform draw of 32 bits: numbers go on until no draw is left for a larger one."""
    import math

    total, chain, k = 0.0, None, 0
    while total < 1 - 2.0**-32:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else 1.0
        chain = (F if chain is None else chain).when(u < total, k)
        k += 1
    return chain.otherwise(k)


def poisson_of(rate: Column, u: Column, largest: float) -> Column:
    """As poisson, for a rate of each row of at most `largest`."""
    import math

    k, left = 1, 1 - math.exp(-largest)
    while left > 2.0**-33:
        left -= math.exp(k * math.log(largest) - largest - math.lgamma(k + 1))
        k += 1
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("total"), F.lit(0).alias("n"))
    step = lambda a, j: F.struct((a["p"] * rate / j).alias("p"), (a["total"] + a["p"] * rate / j).alias("total"), (a["n"] + (u >= a["total"]).cast("int")).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda a: a["n"])
