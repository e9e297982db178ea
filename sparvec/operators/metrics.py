"""What is measured of searches and codes: recall, score errors, reconstruction errors, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import expressions as E


def recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: n_queries, recall_at_1 (the best hit is the true best) and recall_at_k (share of the true k found)."""
    own = hits.filter(F.col("rank") <= k).select("qid", "slot", F.col("rank").alias("r"))
    both = truth.filter(F.col("rank") <= k).join(own, ["qid", "slot"], "left")
    per = both.groupBy("qid").agg(F.max(F.when((F.col("rank") == 1) & (F.col("r") == 1), 1).otherwise(0)).alias("one"), (F.count("r") / F.count(F.lit(1))).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("one").alias("recall_at_1"), F.avg("k").alias("recall_at_k"))


def reconstruction_error(encoded: DataFrame, config: IndexConfig) -> DataFrame:
    """One row: the mean squared distance of decoded from rotated coordinates. encoded has rotated, codes, scale (and the second pass)."""
    width = float(config.padded) ** 0.5
    parts = F.transform("codes", lambda c: E.dequantize(c, config.bits).cast("double") * F.col("scale").cast("double") * width)
    if config.residual:
        more = F.transform("codes2", lambda c: E.dequantize(c, 4).cast("double") * F.col("scale2").cast("double") * width)
        parts = F.zip_with(parts, more, lambda a, b: a + b)
    gaps = F.zip_with(parts, "rotated", lambda a, r: (a - r.cast("double")) * (a - r.cast("double")))
    each = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / config.padded
    return encoded.agg(F.count(F.lit(1)).alias("n"), F.avg(each).alias("mse"))


def storage(n: DataFrame, config: IndexConfig) -> DataFrame:
    """One row: bytes of the vectors, of the codes, and their ratio."""
    raw, mine = 4 * config.dim, config.bytes_per_vector
    c = F.count(F.lit(1))
    return n.agg((c * raw).alias("raw_bytes"), (c * mine).alias("code_bytes"), F.lit(raw / mine).alias("ratio"))
