"""Problem 8: a mix of sources with target shares of the tokens.

Method: Poisson replication. A source's mean repetition rate is target tokens / own tokens. Each document gets a
uniform number from a hash of its id and the seed, the inverse of the source's Poisson distribution turns it
into a count, the document is exploded by that count and the whole is put into the order of a second hash.
No state is shared between tasks and the same seed always gives the same mix.

``max_repeats`` bounds every count. A Poisson count cut at m has a lower mean, so its parameter is raised until
the mean of the cut distribution is the wanted rate; a source that can't reach its target even with every
document m times takes every document m times and is reported as short. The mix is as large as the documents of
the sources in the targets, each once. Sources without documents are reported with zero tokens. Documents with
null source or a source outside the targets are not part of the mix; documents without tokens carry no weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.encode import encode_column
from quillmesh.session import ship


def cut_poisson(rate: float, most: int) -> list[float]:
    """The distribution function at 0..most-1 of a Poisson count cut at ``most`` whose mean is ``rate``. Weights are held as
    logarithms and the parameter is bracketed by doubling, so that neither has a ceiling."""
    if most <= 0 or rate <= 0:
        return [1.0] * max(most, 0)
    if rate >= most:
        return [0.0] * most
    k = np.arange(most)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))]) if most > 1 else np.zeros(1)

    def below(lam: float) -> np.ndarray:
        return np.minimum(np.cumsum(np.exp(k * math.log(lam) - lam - factorials)), 1.0)

    def mean(lam: float) -> float:
        return most - float(below(lam).sum())

    low, high = 0.0, max(rate, 1.0)
    while mean(high) < rate:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return below(high).tolist()


def token_counts(documents: DataFrame, **tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; kept, as the plan and the draw both read it."""
    return encode_column(documents.select("doc_id", "source", "text"), "text", "n_tokens", lengths_only=True, **tokenizer).persist(StorageLevel.MEMORY_AND_DISK)


def source_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of the targets: target_share, max_repeats, docs, tokens, target_tokens, rate, short
    and the cut distribution ``below``."""
    ship(counts.sparkSession)
    own = counts.where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(own, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    t = t.withColumn("target_tokens", F.col("target_share") * F.sum("tokens").over(Window.partitionBy()))  # the few rows of the targets
    t = t.withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("target_tokens"))
    t = t.withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))

    def distributions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["below"] = [cut_poisson(r, int(m)) for r, m in zip(f["rate"], f["max_repeats"], strict=True)]
            yield f

    return t.mapInPandas(distributions, t.schema.simpleString()[7:-1] + ",below:array<double>")


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def repeated(counts: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Documents with their number of uses, before the explosion: (doc_id, source, n_tokens, uses)."""
    at = counts.join(plan.select("source", "below"), "source")
    u = unit("doc_id", seed)
    return at.withColumn("__u", u).withColumn("uses", F.size(F.filter("below", lambda c: F.col("__u") >= c))).drop("below", "__u")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, **tokenizer: str) -> DataFrame:
    """The mix: one row for each use of a document with all its columns, in global shuffled order of ``shuffle_key``."""
    whole = documents.withColumn("__text", F.col("text"))
    counts = encode_column(whole, "text", "n_tokens", lengths_only=True, **tokenizer).persist(StorageLevel.MEMORY_AND_DISK)
    uses = repeated(counts, source_plan(counts, targets), seed).where("uses > 0")
    out = uses.withColumnRenamed("__text", "text").select(*documents.columns, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
    return out.withColumn("shuffle_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).orderBy("shuffle_key", "doc_id", "copy_no")


def report(documents: DataFrame, targets: DataFrame, seed: int = 42, **tokenizer: str) -> DataFrame:
    """Target and reached shares of the mix for each source of the targets."""
    counts = token_counts(documents, **tokenizer)
    plan = source_plan(counts, targets)
    used = repeated(counts, plan, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    out = plan.drop("below").join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    out = out.withColumn("__all", F.sum("mixed_tokens").over(Window.partitionBy()))
    return out.withColumn("actual_share", F.when(F.col("__all") > 0, F.col("mixed_tokens") / F.col("__all")).otherwise(0.0)).drop("__all")


def short_sources(documents: DataFrame, targets: DataFrame, **tokenizer: str) -> DataFrame:
    """Sources of the targets that can't reach their share even with every document at its cap."""
    return source_plan(token_counts(documents, **tokenizer), targets).where("short").select("source")
