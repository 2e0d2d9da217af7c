"""Numeric expressions: scores, vectors, hashes, gap statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import fixed


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def weighted_sum(weights: dict[str, float], columns: dict[str, Column] | None = None) -> Column:
    """Sum of weight * column, in the order of ``weights``."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * (columns[name] if columns else F.col(name))
    return total


# -- vectors -----------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes given as hex text."""
    def as_long(h: Column) -> Column:
        return F.conv(h, 16, -10).cast("bigint")

    return F.bit_count(as_long(a).bitwiseXOR(as_long(b)))


def hmac_sha256_hex(value: Column, secret: bytes) -> Column:
    """HMAC-SHA256 by two nested digests; the key pads are literals."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(k ^ 0x36 for k in key))
    outer = F.lit(bytes(k ^ 0x5C for k in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def pseudonymize(account_id: Column, secret: bytes) -> Column:
    return F.substring(hmac_sha256_hex(account_id, secret), 1, 16)


# -- gaps between posts ------------------------------------------------------
def burstiness(n: Column, mean: Column, sd: Column) -> Column:
    """Goh-Barabasi burstiness from aggregated gaps; -1 is perfectly periodic."""
    return F.when(F.coalesce(n, F.lit(0)) < 2, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(sd - mean, sd + mean), F.lit(0.0))
    )


def gap_bin(gap: Column, bins: int = 12, low: float = 1.0, high: float = 86400.0) -> Column:
    """Log-spaced bin number, values clipped into the range; NULL stays NULL
    (``least`` and ``greatest`` would skip it)."""
    clipped = F.least(F.greatest(gap, F.lit(low)), F.lit(high))
    position = F.floor(F.log10(clipped / low) * bins / math.log10(high / low))
    return F.when(gap.isNotNull(), F.least(position, F.lit(bins - 1)).cast("int"))


def gap_entropy_from_counts(counts: Column, bins: int = 12) -> Column:
    """Normalised Shannon entropy of an array of bin counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
    shares = F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / total)
    h = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(total < 2, F.lit(1.0)).otherwise(h / math.log2(bins))


def uniform_from_key(*key: Column) -> Column:
    """A uniform in (0, 1) that depends on the key only, not on partitioning."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))


def laplace_from_uniform(u: Column, scale: float) -> Column:
    centred = u - 0.5
    return F.lit(-scale) * F.signum(centred) * F.log(F.lit(1.0) - 2.0 * F.abs(centred))


def priority(level: Column, share: Column, shift: Column, reach: Column, weights=None) -> Column:
    """Alert priority on 0..100."""
    w = fixed.PRIORITY_WEIGHTS if weights is None else weights
    return 100.0 * (
        w["burst"] * F.least(F.lit(1.0), level / 5.0)
        + w["coordinated"] * share
        + w["shift"] * F.least(F.lit(1.0), F.abs(shift) / 0.5)
        + w["reach"] * reach
    )
