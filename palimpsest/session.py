"""Session settings that the operators rely on for right results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plain_union(*frames: DataFrame) -> DataFrame:
    """Union by name whose output claims no partitioning.

    A union of inputs that are partitioned alike claims their partitioning, and an aggregate or window above it then skips
    its exchange; with inputs whose partitions adaptive execution has coalesced differently that gave wrong groups here
    (and sometimes an error on PartitioningCollection). The setting is the session's, read when a plan is made.
    """
    out = frames[0]
    out.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
