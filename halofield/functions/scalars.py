"""Scalar rules that differ from the built-in function of a similar name; each has a test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multipliers of the spatial fold hash.
PRIMES = (73856093, 19349663, 83492791)


def sign_or_one(v: Column) -> Column:
    """Sign as 1 or -1: zero counts as 1, and minus zero as -1."""
    negative_zero = (v == 0) & F.format_string("%f", v.cast("double")).startswith("-")
    return F.when((v < 0) | negative_zero, -1.0).otherwise(1.0)


def soft_threshold(v: Column, penalty: Column | float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - penalty, F.lit(0.0))


def hill(value: Column, threshold: float, exponent: float = 1.5) -> Column:
    h = F.pow(F.greatest(value, F.lit(0.0)) / threshold, F.lit(exponent))
    return h / (1 + h)


def fold_id(bins: list[Column], folds: int, variant: str = "floor") -> Column:
    """Fold of a spatial block from its integer coordinates: xor of their products with primes.

    variant floor: remainder as in floor division; absolute: remainder of the absolute value.
    """
    mixed = bins[0] * F.lit(PRIMES[0])
    for b, p in zip(bins[1:], PRIMES[1:]):
        mixed = mixed.bitwiseXOR(b * F.lit(p))
    if variant == "absolute":
        return F.abs(mixed) % folds
    return F.pmod(mixed, F.lit(folds))


def softmax(logits: Column) -> Column:
    """Softmax of an array, stable: shifted by the largest and clamped to -60."""
    shifted = F.transform(logits, lambda v: F.exp(F.greatest(v - F.array_max(logits), F.lit(-60.0))))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x))


def last_argmax(values: Column) -> Column:
    """0-based place of the largest element, the last of equal ones."""
    best = F.array_max(values)
    return F.size(values) - F.array_position(F.reverse(values), best).cast("int")


def truthy(text: Column, yes: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*yes), F.lit(False))


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(v, low), high)


def zscore(v: Column, mean: Column, sd: Column, floor: float = 1e-6, one_below: bool = False) -> Column:
    """(v - mean) / sd with a floor under sd; one_below: an sd under the floor counts as 1 instead."""
    scale = F.when(sd < floor, 1.0).otherwise(sd) if one_below else F.greatest(sd, F.lit(floor))
    return (v - mean) / scale


def draw(seed: int, *keys: Column | str) -> Column:
    """A random-looking text of hexadecimal digits that follows from seed and keys alone; for orders."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *keys))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to 1, without 1, in steps of 2 ** -28, that follows from seed and keys alone."""
    return F.conv(F.substring(draw(seed, *keys), 1, 7), 16, 10).cast("long") / float(1 << 28)


# The 64-bit FNV-1a start value in halves; its prime is 2 ** 40 + 435.
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435


def fnv1a(text: str) -> Column:
    """The 64-bit FNV-1a hash of a text's ASCII characters as decimal(20, 0), in halves of 32 bits so that nothing overflows."""
    half = 0xFFFFFFFF
    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("hi"), F.lit(FNV_LOW).cast("long").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        lo = h["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        low = lo * FNV_PRIME_LOW
        high = h["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(F.lit(half)).alias("hi"), low.bitwiseAND(F.lit(half)).alias("lo"))

    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    wide = lambda c: c.cast("decimal(20,0)")
    return (wide(h["hi"]) * F.lit(4294967296).cast("decimal(20,0)") + wide(h["lo"])).cast("decimal(20,0)")


def natural_key(text: str, digits: int = 20) -> Column:
    """A text that sorts as its lower-case form with runs of digits as numbers (up to so many digits)."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), digits, "0")).otherwise(F.lower(p))), "")


def euclid(gaps: list[Column]) -> Column:
    """The length of a difference, from its parts."""
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
