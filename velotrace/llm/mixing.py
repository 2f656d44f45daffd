"""Mixing sources to target shares of tokens (problem 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.llm.bpe import TOKENIZERS, VOCABULARY, count_tokens
from velotrace.operators.skew import joined_by
from velotrace.session import cut

#: Documents of about this many are ordered in one task.
ORDERED = 50_000


def unit(seed: int, ident: Column) -> Column:
    """A number in (0, 1) from a hash, the same in every run and on every machine."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), ident), 11).cast("double") + 0.5) / float(1 << 53)


def with_plan(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Join of documents with one row per source."""
    return joined_by(rows, plan, ["source"], "source", F.col("doc_id"), 500_000, how)


def allotment(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """source, share (of those with documents), cap, want (tokens), whole (copies of every document), rest (tokens by sampling).

    Without a total the mix is the largest in which every source that has documents reaches its share
    with no document used more often than its cap.
    """
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("cap")
    )
    here = sizes.where(F.col("tokens") > 0).join(t, "source")
    everything = here.agg(F.sum("target_share").alias("present"), F.min(F.col("cap") * F.col("tokens") / F.col("target_share")).alias("reachable"))
    both = here.join(F.broadcast(everything), F.lit(True))  # one row
    share = F.col("target_share") / F.col("present")
    size = F.lit(float(total)) if total is not None else F.col("reachable") * F.col("present")
    want = F.least(share * size, (F.col("cap") * F.col("tokens")).cast("double"))
    whole = F.least(F.floor(want / F.col("tokens") + 1e-12), F.col("cap"))
    return both.select("source", share.alias("share"), "cap", "tokens", want.alias("want"), whole.alias("whole"), F.when(whole < F.col("cap"), F.greatest(want - whole * F.col("tokens"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rest"))


def inclusion_scale(counted: DataFrame, plan: DataFrame, size_power: float) -> DataFrame:
    """source, scale: a document of n tokens is included with min(1, scale * n ** size_power), which gives `rest` tokens on average.

    From the counts of each length: with lengths falling, those that would be over 1 are certain, the scale is that of the others.
    """
    lengths = counted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("c")).join(plan.select("source", "rest"), "source")
    n = F.col("n_tokens").cast("double")
    w = F.pow(n, F.lit(float(size_power)))
    longer = Window.partitionBy("source").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    row = lengths.withColumn("above", F.coalesce(F.sum(n * F.col("c")).over(longer), F.lit(0.0))).withColumn("below", F.sum(w * n * F.col("c")).over(shorter))
    scale = (F.col("rest") - F.col("above")) / F.col("below")
    ok = (scale >= 0) & (scale * w <= 1 + 1e-12)
    return row.withColumn("scale", F.when(ok, scale)).groupBy("source").agg(F.max_by("scale", F.when(ok, F.col("n_tokens"))).alias("scale"))


def mixed(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20, size_power: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies) and the plan per source, from counted documents (doc_id, source, n_tokens).

    Each document of a source gets the whole copies that fit its share; the rest is a Pareto sample: documents are ranked by the
    odds of a random number over the odds of their inclusion (see inclusion_scale), certain ones first, and taken in this order
    until the rest is filled to the nearest document, so the size in tokens is fixed. The order is made by
    summing ranks in bins, and only the bin in which a source is filled is sorted: no source is sorted as a whole.

    Documents without source, without target or without tokens are not used. Empty tables give an empty mix.
    """
    usable = counted.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    sizes = usable.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = allotment(sizes, targets, total)
    scale = inclusion_scale(usable, plan, size_power)
    plan = cut(plan.join(sizes.select("source", "docs"), "source").join(scale, "source", "left"))
    bins = max(1024, (plan.agg(F.coalesce(F.max("docs"), F.lit(0))).first()[0]) // ORDERED * 2)
    p = F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("n_tokens").cast("double"), F.lit(float(size_power))))
    u = unit(seed, F.col("doc_id"))
    # odds(u) / odds(p), mapped to [0, 1): q / (1 + q)
    odd = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    ranked = with_plan(usable.select("doc_id", "source", "n_tokens"), plan.select("source", "whole", "rest", "scale"))
    ranked = ranked.withColumn("place", F.when(F.col("rest") > 0, F.when(p >= 1, F.lit(0.0)).otherwise(odd))).withColumn("bin", F.when(F.col("place").isNotNull(), F.least(F.floor(F.col("place") * bins), F.lit(bins - 1))))
    per = ranked.where(F.col("bin").isNotNull()).groupBy("source", "bin").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = per.withColumn("begin", F.coalesce(F.sum("sum").over(upto), F.lit(0))).where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("sum") >= F.col("rest")))
    edge = filled.select("source", F.col("bin").alias("edge_bin"), "begin")
    placed = with_plan(ranked, edge, "left")
    inside = placed.where(F.col("bin") == F.col("edge_bin"))
    order = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    last = inside.withColumn("extra", (before + F.col("n_tokens") / 2 <= F.col("rest")).cast("long"))
    others = placed.where(~F.col("bin").eqNullSafe(F.col("edge_bin")) | F.col("bin").isNull())
    sure = F.when(F.col("bin").isNull(), 0).when(F.col("edge_bin").isNull(), 1).when(F.col("bin") < F.col("edge_bin"), 1).otherwise(0)
    cols = ["doc_id", "source", "n_tokens", "whole", "extra"]
    used = last.select(*cols).unionByName(others.withColumn("extra", sure.cast("long")).select(*cols))
    return used.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0"), plan


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20, size_power: float = 1.0, folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """mixed() of documents (doc_id, source, text), whose tokens are counted here, and shares()."""
    counted = cut(count_tokens(documents, "doc_id", "source", folder=folder, name=name))
    result, plan = mixed(counted, targets, total, seed, size_power)
    return result, shares(result, plan, targets)


def shares(result: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_docs, n_tokens_available, n_tokens_used, actual_share, most_copies for every target.

    A source without documents has 0 in all and the share 0.
    """
    used = result.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most"))
    total = used.agg(F.sum("used").alias("all_used"))
    t = targets.select("source", "target_share", "max_repeats")
    rows = t.join(used, "source", "left").join(plan.select("source", "tokens"), "source", "left").join(F.broadcast(total), F.lit(True), "left")  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        "source", "target_share", "max_repeats", zero("n_docs").alias("n_docs"), zero("tokens").alias("n_tokens_available"), zero("used").alias("n_tokens_used"),
        F.coalesce(zero("used") / F.col("all_used"), F.lit(0.0)).alias("actual_share"), zero("most").alias("most_copies"),
    )
