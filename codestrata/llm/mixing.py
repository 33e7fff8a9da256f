"""A mix of sources at target shares of its total size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.byte_bpe import VOCABULARIES, encode_column
from codestrata.operators.running import running
from codestrata.session import stage


def token_sizes(documents: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """``doc_id, source, tokens`` of every document; null and empty texts have 0 tokens."""
    keyed = documents.select(F.struct("doc_id", "source").alias("k"), "text")
    return encode_column(keyed, "k", "text", vocabularies=vocabularies).select("k.doc_id", "k.source", F.size("ids").cast("long").alias("tokens"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of ``targets``: ``source, target_share, max_repeats, available, budget``.

    Without ``total_tokens`` the mix is as large as it can be with every share met: the least of
    ``max_repeats * available / share`` over the sources that have tokens. A given total may ask more of a source than
    its repeats hold; then its budget is all it has, and the reached share tells. Null shares and repeats count as 0;
    of repeated targets of a source the largest share and repeats count; a null source is no target.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    both = wanted.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    if total_tokens is None:
        bound = both.where("available > 0 and target_share > 0").agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("total"))
        both = both.crossJoin(F.broadcast(bound))  # one row
    else:
        both = both.withColumn("total", F.lit(float(total_tokens)))
    asked = F.floor(F.coalesce("total", F.lit(0.0)) * F.col("target_share") + 1e-6).cast("long")
    return both.withColumn("budget", F.least(asked, F.col("max_repeats") * F.col("available"))).drop("total")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabularies: str = VOCABULARIES) -> tuple[DataFrame, DataFrame]:
    """The mix, and the shares it reaches.

    Documents of a source are put in the order of a random hash. Their running token sum, made by a range sort over
    many tasks, is cut at the source's budget: every document appears once for each whole epoch in the budget, and
    once more while the middle of its tokens lies before the rest of the budget. So a source misses its budget by at
    most half of its largest document.

    Mix: ``doc_id, source, tokens, times`` (times >= 1). Shares: ``source, target_share, max_repeats, available,
    budget, reached, share`` for every target, also those without documents. Documents of other or null sources are
    not in the mix; repeated rows are documents of their own; empty tables give an empty mix.
    """
    sizes = stage(token_sizes(documents, vocabularies))
    plan = stage(budgets(sizes, targets, total_tokens))
    keyed = sizes.join(plan.select("source", "available", "budget", "max_repeats"), "source").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "source"))
    summed = running(keyed, ["source"], [F.col("_key"), F.col("doc_id")], "tokens", "_sum")
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0))
    rest = F.when(F.col("available") > 0, F.col("budget") % F.col("available")).otherwise(F.lit(0))
    once_more = (rest > 0) & (F.col("_sum") - F.col("tokens") / 2 <= rest)
    counted = summed.withColumn("times", F.least(F.col("max_repeats"), (epochs + once_more.cast("int"))).cast("int"))
    chosen = stage(counted.where("times > 0").select("doc_id", "source", "tokens", "times"))
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached"))
    whole = reached.agg(F.sum("reached").alias("_whole"))
    shares = plan.join(reached, "source", "left").crossJoin(F.broadcast(whole)).withColumn("reached", F.coalesce("reached", F.lit(0).cast("long")))
    share = F.when(F.col("_whole") > 0, F.col("reached") / F.col("_whole")).otherwise(F.lit(0.0))
    return chosen, shares.select("source", "target_share", "max_repeats", "available", "budget", "reached", share.alias("share"))
