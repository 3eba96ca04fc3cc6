"""Session settings the operators count on."""

from __future__ import annotations

SETTINGS = {
    # run-time plans: small sides are broadcast, small partitions joined up,
    # and partitions of hot keys split, also where that costs a shuffle
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # times are timestamps without zone; conversions must not depend on the host
    "spark.sql.session.timeZone": "UTC",
}
"""For a cluster add ``spark.checkpoint.dir`` (a shared folder) and
``spark.sql.shuffle.partitions`` (two to three times the cores, or more where
partitions would outgrow an executor's memory)."""
