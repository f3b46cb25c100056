"""Mixing sources to target weights by Poisson replication.

Each document of a source is repeated a Poisson number of times whose mean is the source's target
rate: target share * total size / size of the source. The number comes from inverting the Poisson
distribution at a uniform hash of seed and doc_id, so it can be computed again anywhere. Copies
are explode()d and dealt out by a hash of seed, doc_id and copy, in whose order they then stand, to as
many partitions as their expected size wants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_enough, written


def uniform(*parts) -> F.Column:
    """52 bits of an MD5 as a number in (0, 1)."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_rates(docs: DataFrame, *, power: float = 0.5, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, size, rate) for each source; size: code points of its texts plus one for each document.

    Target shares are the given weights (sources without one: 0), or size ** power, made to sum
    to 1. The rates keep the expected total size.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(share)
    shares = sizes.withColumn("share", share)
    total = shares.agg(F.sum("size").cast("double").alias("all_size"), F.sum("share").alias("all_share"))
    return shares.crossJoin(F.broadcast(total)).select("source", "size", F.when(F.col("all_share") > 0, F.col("share") / F.col("all_share") * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))


def poisson_steps(rate) -> F.Column:
    """The distribution function at 0, 1, ... up to where nothing is left for 52 bits; a rate over 500 works in log space too."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), last),
        F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps")),
        lambda acc, k: F.struct(
            (acc["log_k"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)).alias("log_k"),
            (acc["sum"] + F.exp(k * F.log(rate) - rate - (acc["log_k"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)))).alias("sum"),
            F.concat(acc["steps"], F.array(acc["sum"] + F.exp(k * F.log(rate) - rate - (acc["log_k"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0))))).alias("steps"),
        ),
        lambda acc: acc["steps"],
    )
    return F.when(rate > 0, terms).otherwise(F.array(F.lit(1.0)))


def mixed(docs: DataFrame, *, power: float = 0.5, weights: dict[str | None, float] | None = None, seed: int = 7, shuffle: bool = True, chars: int = 100_000_000) -> DataFrame:
    """docs (doc_id, text, source, ...) with copy_no (from 0) and mix_key, repeated to the target rates.

    A null source is a source of its own; a null or empty text has size 1; a null doc_id hashes
    as an empty one; rows that repeat a doc_id are repeated equally often; an empty table gives
    no rows. Columns of docs named copy_no or mix_key are replaced. Rates are one row a source,
    counted once: they are broadcast while there are at most 10,000, and beyond that Spark splits
    hot sources of a shuffled join. `chars`: code points of text a partition is to hold.
    """
    docs = docs.drop("copy_no", "mix_key")
    known = written(source_rates(docs, power=power, weights=weights), "rates")
    rates = small_enough(known, 10_000).select(F.col("source").alias("__source"), poisson_steps(F.col("rate")).alias("__steps"))
    u = uniform(F.lit(seed), F.col("doc_id"))
    out = docs.join(rates, docs["source"].eqNullSafe(F.col("__source"))).withColumn("__u", u)
    copies = F.size(F.filter("__steps", lambda s: s < F.col("__u")))
    out = out.withColumn("__copies", copies).drop("__steps", "__u", "__source").where("__copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    out = out.withColumn("mix_key", uniform(F.lit(seed + 1), F.col("doc_id"), F.col("copy_no")))
    if shuffle:
        expected = known.agg(F.sum(F.col("size") * F.col("rate"))).first()[0] or 0.0
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(expected // chars) + 1)
        out = out.repartition(n, "mix_key").sortWithinPartitions("mix_key", "doc_id")
    return out


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "source", F.col("copy_no").cast("long").alias("copy_no"), "mix_key", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


ORACLE = """
WITH s AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
), t AS (SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_share FROM s),
r AS (SELECT source, sqrt(size) / all_share * all_size / size AS rate FROM s, t),
k AS (SELECT unnest(range(0, 2000)) AS k),
p AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step
  FROM r, k WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)
), st AS (SELECT source, list(step ORDER BY k) AS steps FROM p GROUP BY source),
d AS (
  SELECT doc_id, documents.source, coalesce(length(text), 0)::BIGINT AS n_chars,
    len(list_filter(steps, lambda x: x < (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) AS copies
  FROM documents JOIN st ON documents.source IS NOT DISTINCT FROM st.source
), c AS (SELECT doc_id, source, n_chars, unnest(range(0, copies)) AS copy_no FROM d)
SELECT doc_id, source, copy_no::BIGINT AS copy_no,
  (('0x' || substr(md5('8:' || doc_id || ':' || copy_no), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS mix_key, n_chars
FROM c
"""
