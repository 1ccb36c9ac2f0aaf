"""Scalar kernels as column expressions; none leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null where its length is 0 or not finite."""
    n = F.sqrt(dot(v, v))
    return F.when((n > 1e-12) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))


def _sides(a: str, b: str) -> tuple[Column, Column]:
    c = F.col
    w = F.least(c(f"{a}.x2"), c(f"{b}.x2")) - F.greatest(c(f"{a}.x1"), c(f"{b}.x1"))
    h = F.least(c(f"{a}.y2"), c(f"{b}.y2")) - F.greatest(c(f"{a}.y1"), c(f"{b}.y1"))
    return F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))


def area(box: str) -> Column:
    return F.greatest(F.col(f"{box}.x2") - F.col(f"{box}.x1"), F.lit(0.0)) * F.greatest(F.col(f"{box}.y2") - F.col(f"{box}.y1"), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct columns; 0 where the union is empty."""
    w, h = _sides(a, b)
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def intersection_over_smaller(a: str, b: str) -> Column:
    w, h = _sides(a, b)
    least = F.least(area(a), area(b))
    return F.when(least > 0, w * h / least).otherwise(0.0)


def center_distance(a: str, b: str) -> Column:
    def mid(box: str, axis: str) -> Column:
        return (F.col(f"{box}.{axis}1") + F.col(f"{box}.{axis}2")) / 2

    return F.hypot(mid(a, "x") - mid(b, "x"), mid(a, "y") - mid(b, "y"))


def iou_plain(a: str, b: str) -> Column:
    """Intersection over union with areas as products of signed sides, 0 where the union isn't positive."""

    def plain(box: str) -> Column:
        return (F.col(f"{box}.x2") - F.col(f"{box}.x1")) * (F.col(f"{box}.y2") - F.col(f"{box}.y1"))

    w, h = _sides(a, b)
    union = plain(a) + plain(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def diagonal(width: float, height: float) -> float:
    return math.hypot(width, height)


def center_distance_relative(a: str, b: str) -> Column:
    """Centre distance over the longer diagonal of the two boxes, at least 1."""

    def diag(box: str) -> Column:
        return F.hypot(F.col(f"{box}.x2") - F.col(f"{box}.x1"), F.col(f"{box}.y2") - F.col(f"{box}.y1"))

    return center_distance(a, b) / F.greatest(F.lit(1.0), diag(a), diag(b))


def polygon_box(points: Column) -> Column:
    """The box around an array of points x, y; nulls for an empty one."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def tiles(width: Column, height: Column, n: int, overlap: float) -> Column:
    """n times n tiles ``row, col, x1, y1, x2, y2`` that overlap by a share of their side, rounded half to even."""

    def edges(size: Column, k: int) -> tuple[Column, Column]:
        side = size / (n - (n - 1) * overlap)
        start = side * (1 - overlap) * k
        return F.bround(start, 0), F.bround(F.least(size, start + side), 0)

    out = []
    for row in range(n):
        for col in range(n):
            (x1, x2), (y1, y2) = edges(width, col), edges(height, row)
            out.append(F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    return F.array(*out)


def semantic_tier(tiers: list[tuple[Column, Column, float]], rest: float) -> Column:
    """The value of the first pair of columns that are equal, both known; the rest's otherwise."""
    out = F.lit(rest)
    for a, b, value in reversed(tiers):
        out = F.when(a == b, value).otherwise(out)
    return out


def first_uncertain(facts: list[tuple[str, Column, Column]]) -> tuple[Column, Column, Column]:
    """Status, deciding fact and confidence of ordered facts ``name, truth, confidence``: the first unknown one asks
    (NEEDS_USER), the first false one rules out (NOT_APPLICABLE), whichever comes first; all true trigger. Confidence is
    the smallest, 0 while a fact is unknown."""
    status, by = F.lit("TRIGGERED"), F.lit(None).cast("string")
    for name, truth, _ in reversed(facts):
        status = F.when(truth.isNull(), "NEEDS_USER").when(~truth, "NOT_APPLICABLE").otherwise(status)
        by = F.when(truth.isNull() | ~truth, F.lit(name)).otherwise(by)
    known = F.least(*[c for _, _, c in facts])
    any_unknown = F.lit(False)
    for _, truth, _ in facts:
        any_unknown = any_unknown | truth.isNull()
    return status, by, F.when(any_unknown, 0.0).otherwise(known)


def label_form(c: Column) -> Column:
    """Lower case; everything but ASCII letters and digits is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; [0, 1] without trials."""
    n, p = total.cast("double"), hits / total
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = total == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series at x + 8."""
    z = x + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    return series - F.ln(steps)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts b and c: twice the binomial tail at one half, 1 at most, null without any.

    The largest term of the tail comes from logarithms and the others from it, downwards, until they no longer count:
    about ten standard deviations, whatever the counts.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) - n * math.log(2.0))
    terms = F.least(k, F.ceil(10 * F.sqrt(n)) + 60).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        t = s["term"] * (k - i) / (n - k + i + 1.0)
        return F.struct(t.alias("term"), (s["total"] + t).alias("total"))

    tail = F.aggregate(steps, start, add)["total"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * top * tail))


def required_trials(p: Column, half_width: float, z: float = 1.96) -> Column:
    """The smallest number of trials whose Wilson interval around a share p is no wider than half_width to either side.

    The condition is a quadratic inequality in the number of trials, so nothing is searched."""
    w2, z2 = half_width * half_width, z * z
    b = 2 * w2 * z2 - z2 * p * (1 - p)
    root = (-b + F.sqrt(b * b - 4 * w2 * (w2 * z2 * z2 - z2 * z2 / 4))) / (2 * w2)
    return F.greatest(F.lit(1), F.ceil(F.nanvl(root, F.lit(1.0)) - 1e-6)).cast("long")


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first eight bytes of the key's SHA-256 modulo the number of buckets, as an unsigned number."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def set_id(prefix: str, ids: Column, length: int = 12) -> Column:
    """A name for a set of ids that doesn't depend on their order."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, length))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """``sorted[min(n - 1, int(n * p))]`` of a sorted array."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(n, F.floor(n * F.lit(p)).cast("int") + 1))
