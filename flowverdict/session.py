"""Session settings the jobs are written for. The caller creates the session."""

from __future__ import annotations

# Shuffle sizes follow the data: adaptive execution merges small partitions and splits
# skewed ones, so the partition number is an upper bound and not a tuning knob.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call graphs differ in size by orders of magnitude, so Arrow batches are cut by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def configured(builder, **extra):
    """A session builder with ``SETTINGS`` and ``extra`` applied."""
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder
