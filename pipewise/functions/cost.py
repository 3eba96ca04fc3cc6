"""Cost, size and gain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewise.functions.fixed_values import (
    BROADCAST_LIMIT_MB,
    GAIN_THRESHOLD_PCT,
    PHOTON_MULTIPLIER,
)


def cost_weight(node_weight: Column, workers: Column, photon: Column,
                photon_multiplier: float = PHOTON_MULTIPLIER) -> Column:
    """Node weight times nodes (workers and the driver), dearer with photon.

    An unknown node weighs 1.0; an unknown number of workers is one worker;
    zero workers is a driver on its own.
    """
    nodes = F.coalesce(workers, F.lit(1)) + 1
    factor = F.when(photon, F.lit(float(photon_multiplier))).otherwise(F.lit(1.0))
    return F.round(F.coalesce(node_weight, F.lit(1.0)) * nodes * factor, 2)


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1048576.0)


def broadcast_safe(size_bytes: Column, limit_mb: float = BROADCAST_LIMIT_MB) -> Column:
    """Decided on the unrounded size, strictly under the limit."""
    return (size_bytes >= 0) & (size_mb(size_bytes) < F.lit(float(limit_mb)))


def gain_pct(original_s: Column, current_s: Column) -> Column:
    """Percent saved; 0 without an original, NULL without a current duration."""
    known = F.coalesce(original_s, F.lit(0.0))
    pct = F.when(known > 0, (known - current_s) / known * 100.0).otherwise(F.lit(0.0))
    return F.when(current_s.isNotNull(), pct)


def gain_status(current_s: Column, pct: Column,
                threshold: float = GAIN_THRESHOLD_PCT) -> Column:
    return (
        F.when(current_s.isNull(), "no_ran")
        .when(pct > threshold, "improved")
        .when(pct < -threshold, "regressed")
        .otherwise("neutral")
    )


def user_part(address: Column) -> Column:
    """What stands before the ``@``; NULL becomes empty."""
    return F.split_part(F.coalesce(address, F.lit("")), F.lit("@"), F.lit(1))


def is_stale(stored_hash: Column, current_hash: Column) -> Column:
    """The script changed since its hash was stored (no stored hash: never)."""
    return (F.coalesce(stored_hash, F.lit("")) != "") & (stored_hash != current_hash)
