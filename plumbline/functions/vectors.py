"""Vector expressions built from Spark's array functions; no Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vsum(x: Column | str) -> Column:
    """Sum of an array's entries."""
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return vsum(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v * v))


def add(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def sub(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a - b)


def scale(x: Column | str, s: Column | float) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else s
    return F.transform(_c(x), lambda v: v * s)


def l2_distance(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(vsum(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b))))


def l1_distance(x: Column | str, y: Column | str) -> Column:
    return vsum(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def l2_normalize(x: Column | str, mode: str = "l2") -> Column:
    """x / (|x| + 1e-12); mode 'none' leaves the vector as it is."""
    if mode == "none":
        return _c(x)
    if mode != "l2":
        raise ValueError(f"unknown normalisation {mode!r}")
    length = norm(x) + F.lit(NORM_EPS)
    return F.transform(_c(x), lambda v: v / length)


def cosine(x: Column | str, y: Column | str) -> Column:
    return dot(x, y) / ((norm(x) + F.lit(NORM_EPS)) * (norm(y) + F.lit(NORM_EPS)))


def center_then_normalize(x: Column | str, mean: Column | str) -> Column:
    return l2_normalize(sub(x, mean))


def logsumexp(x: Column | str) -> Column:
    top = F.array_max(_c(x))
    return top + F.log(F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))


def argmin_index(x: Column | str) -> Column:
    """0-based position of the smallest entry; the first on ties."""
    return (F.array_position(_c(x), F.array_min(_c(x))) - 1).cast("int")


def argmax_index(x: Column | str) -> Column:
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of two equally long arrays; null when either is constant."""
    n = F.size(_c(x))
    mx, my = vsum(x) / n, vsum(y) / n
    cov = vsum(F.zip_with(_c(x), _c(y), lambda a, b: (a - mx) * (b - my)))
    vx = vsum(F.transform(_c(x), lambda a: (a - mx) * (a - mx)))
    vy = vsum(F.transform(_c(y), lambda b: (b - my) * (b - my)))
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def finite(x: Column | str) -> Column:
    """The value where it is a finite number, else null."""
    c = _c(x).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(ok, c)


def draw_key(seed: int, rep: Column | int, sample_id: Column | str) -> Column:
    """Text key whose order is the deterministic stand-in for a random draw."""
    rep = F.lit(rep) if isinstance(rep, int) else rep
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), rep.cast("string"), _c(sample_id).cast("string")))


def unit_draw(seed: int, rep: Column | int, sample_id: Column | str) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of the draw key."""
    digits = F.substring(draw_key(seed, rep, sample_id), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def condition_signature(attrs: list[str]) -> Column:
    """`a0_b3` text of a condition, attribute names in alphabetical order."""
    return F.concat_ws("_", *[F.concat(F.lit(a), F.col(a).cast("string")) for a in sorted(attrs)])


def hamming_weight(attrs: list[str]) -> Column:
    return sum((F.col(a) for a in attrs[1:]), F.col(attrs[0]))


def format_condition(attrs: list[str]) -> Column:
    """Readable `a=0, b=3` text in the caller's attribute order."""
    return F.concat_ws(", ", *[F.concat(F.lit(a + "="), F.col(a).cast("string")) for a in attrs])
