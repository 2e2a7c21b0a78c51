"""Merging rows into the memories that they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEPARATOR = r"[,\s]+"


def merged_into(memory: DataFrame, new: DataFrame, into: DataFrame, now: float) -> DataFrame:
    """memory, with `_hit`, after the rows of new (id, _n, content, tags, weight ...) are merged, in order of _n, into the ids that into (id, _into) names.

    The longest text stays (a tie keeps the older), tags are joined in order, the weight is the largest, each merge counts
    an access and adds 0.05 and the row's own reinforcement, 1 at most.
    """
    gain = F.greatest(F.lit(0.0), F.coalesce("reinforcement", F.lit(0.0))) if "reinforcement" in new.columns else F.lit(0.0)
    one = F.struct("_n", "content", F.split(F.coalesce("tags", F.lit("")), _SEPARATOR).alias("tags"))
    said = new.join(into, "id").groupBy(F.col("_into").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("_new"), F.max("weight").alias("_w"), F.count(F.lit(1)).alias("_times"), F.sum(gain + 0.05).alias("_gain"))
    hit = F.col("_new").isNotNull()
    longest = F.aggregate("_new", F.coalesce("content", F.lit("")), lambda old, x: F.when(F.length(x["content"]) > F.length(old), x["content"]).otherwise(old))
    tags = F.array_join(F.filter(F.array_distinct(F.concat(F.split(F.coalesce("tags", F.lit("")), _SEPARATOR), F.flatten(F.transform("_new", lambda x: x["tags"])))), lambda x: x != ""), " ")
    changes = {"content": longest, "tags": tags, "weight": F.greatest("weight", "_w"), "access_count": F.col("access_count") + F.col("_times").cast("int"), "last_accessed": F.lit(now), "reinforcement": F.least(F.lit(1.0), F.coalesce("reinforcement", F.lit(0.0)) + F.col("_gain"))}
    x = memory.join(said, "id", "left")
    x = x.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items() if c in memory.columns})
    return x.select(*memory.columns, hit.alias("_hit"))
