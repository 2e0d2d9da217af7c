"""Experimental behaviour likelihood of accounts, and two simple baselines.

Uses timing and content reuse only, never audience inference. A signal for
review; it does not identify automated accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.numeric import logistic, weighted_sum
from driftlens.functions.sequence import top_n_per_group
from driftlens.functions.time import display_hour, epoch_seconds, slot
from driftlens.operators.filters import AUTHOR_KEY
from driftlens.operators.gaps import gap_statistics, inter_post_gaps


def _with_text_hash(posts: DataFrame) -> DataFrame:
    return posts if "text_hash" in posts.columns else posts.withColumn("text_hash", F.md5("text"))


def seen_before(posts: DataFrame) -> DataFrame:
    """Posts plus ``seen_before``: an earlier post of the account has the same
    text. Decided against the first use per (account, text), not by ranking
    all uses of a text in one task."""
    d = _with_text_hash(posts)
    firsts = d.groupBy(*AUTHOR_KEY, "text_hash").agg(F.min(F.struct("created_at", "post_id")).alias("_first"))
    return d.join(firsts, [*AUTHOR_KEY, "text_hash"]).withColumn(
        "seen_before", F.col("_first.post_id") != F.col("post_id")
    ).drop("_first", *([] if "text_hash" in posts.columns else ["text_hash"]))


def template_share(posts: DataFrame, min_accounts: int = 5) -> DataFrame:
    """(platform, author_id, template_share): posts that repeat the account's own
    earlier text, or use a text of at least ``min_accounts`` accounts.

    Works on (account, text) counts: of n uses of a text all n count when the
    text is widespread, otherwise all but the first.
    """
    uses = _with_text_hash(posts).groupBy(*AUTHOR_KEY, "text_hash").agg(F.count("*").alias("n"))
    spread = uses.groupBy("text_hash").agg(F.countDistinct("author_id").alias("accounts"))
    repeated = F.when(F.col("accounts") >= min_accounts, F.col("n")).otherwise(F.col("n") - 1)
    return uses.join(spread, "text_hash").groupBy(*AUTHOR_KEY).agg(
        (F.sum(repeated) / F.sum("n")).alias("template_share")
    )


def night_and_young(posts: DataFrame, accounts: DataFrame, young_days: int = 180) -> DataFrame:
    """(platform, author_id, night_share, young): posts before 05:00 display
    time, and whether the account was created fewer than ``young_days`` whole
    days before its first post."""
    d = posts.groupBy(*AUTHOR_KEY).agg(
        F.avg((display_hour(F.col("created_at")) < 5).cast("double")).alias("night_share"),
        F.min("created_at").alias("_first"),
    )
    made = accounts.where(F.col("created_at").isNotNull()).select(
        "platform", F.col("account_id").alias("author_id"), F.col("created_at").alias("_made")
    )
    days = F.floor((epoch_seconds(F.col("_first")) - epoch_seconds(F.col("_made"))) / 86400)
    return d.join(made, AUTHOR_KEY, "left").select(
        *AUTHOR_KEY, "night_share", F.coalesce((days < young_days).cast("double"), F.lit(0.0)).alias("young")
    )


def behaviour_likelihood(posts: DataFrame, accounts: DataFrame, coord_accounts: DataFrame | None = None, *,
                         weights: dict[str, float] | None = None, bias: float = fixed.BEHAVIOUR_BIAS,
                         min_accounts: int = 5) -> DataFrame:
    """(platform, account_id, likelihood, features) for accounts with >= 2 posts.
    An account in several clusters keeps its highest co_sync."""
    weights = fixed.BEHAVIOUR_WEIGHTS if weights is None else weights
    gaps = gap_statistics(inter_post_gaps(posts, AUTHOR_KEY), AUTHOR_KEY)
    regular = F.when(F.col("n_gaps") >= 2, F.greatest(F.lit(0.0), -F.col("burstiness"))).otherwise(0.0)
    d = (
        gaps.where(F.col("n_posts") >= 2).select(*AUTHOR_KEY, "n_posts", regular.alias("regularity"))
        .join(template_share(posts, min_accounts).withColumnRenamed("template_share", "template"), AUTHOR_KEY)
        .join(night_and_young(posts, accounts), AUTHOR_KEY)
    )
    if coord_accounts is not None:
        sync = coord_accounts.groupBy("platform", F.col("account_id").alias("author_id")).agg(
            F.max("reasons.co_sync").alias("co_sync")
        )
        d = d.join(sync, AUTHOR_KEY, "left").fillna(0.0, ["co_sync"])
    else:
        d = d.withColumn("co_sync", F.lit(0.0))
    names = [*fixed.BEHAVIOUR_WEIGHTS, "n_posts"]
    return d.select(
        "platform", F.col("author_id").alias("account_id"),
        logistic(weighted_sum(weights) - bias).alias("likelihood"),
        F.struct(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in names]).alias("features"),
    )


def likelihood_histogram(behaviour: DataFrame) -> DataFrame:
    return behaviour.groupBy((F.floor(F.col("likelihood") * 10) / 10).alias("bin")).agg(F.count("*").alias("n"))


def baseline_age_ratio(posts: DataFrame, accounts: DataFrame, max_days: int = 365, max_ratio: float = 0.5) -> DataFrame:
    """Accounts young at their first post with few followers per following."""
    first = posts.groupBy(F.col("author_id").alias("account_id")).agg(F.min("created_at").alias("_first"))
    d = accounts.where(F.col("created_at").isNotNull()).join(first, "account_id")
    days = F.floor((epoch_seconds(F.col("_first")) - epoch_seconds(F.col("created_at"))) / 86400)
    following = F.greatest(F.lit(1), F.coalesce(F.col("following"), F.lit(1)))
    ratio = F.coalesce(F.col("followers"), F.lit(0)) / following
    return d.where((days < max_days) & (ratio < max_ratio)).select("account_id").distinct()


def exact_duplicate_bursts(posts: DataFrame, seconds: int = 60, min_accounts: int = 5) -> DataFrame:
    """Accounts in any sliding window of ``seconds`` in which at least
    ``min_accounts`` distinct accounts posted one text.

    A slot of that width with enough accounts qualifies as a whole. Any other
    qualifying window spans two slots; there the ``min_accounts`` latest
    accounts of the earlier slot and earliest accounts of the later slot decide,
    so the sliding frame never holds more than twice that many rows.
    """
    from pyspark.sql import Window

    k = min_accounts
    d = _with_text_hash(posts).select(
        "text_hash", "author_id", F.unix_micros("created_at").alias("t"), slot(F.col("created_at"), seconds).alias("s")
    )
    ends = d.groupBy("text_hash", "s", "author_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    full = ends.groupBy("text_hash", "s").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("text_hash", "s")
    whole = ends.join(full, ["text_hash", "s"], "left_semi").select(F.col("author_id").alias("account_id"))
    slots = ["text_hash", "s"]
    later = top_n_per_group(ends, slots, [F.col("lo"), F.col("author_id")], k).select(*slots, "author_id", F.col("lo").alias("t"))
    earlier = top_n_per_group(ends, slots, [F.desc("hi"), F.col("author_id")], k).select(
        "text_hash", (F.col("s") + 1).alias("s"), "author_id", F.col("hi").alias("t")
    )
    both = later.unionByName(earlier)
    span = seconds * 1_000_000
    w = Window.partitionBy(*slots).orderBy("t")
    marked = both.withColumn("_n", F.size(F.collect_set("author_id").over(w.rangeBetween(-span, 0))))
    hit = F.max((F.col("_n") >= k).cast("int")).over(w.rangeBetween(0, span))
    spanning = marked.withColumn("_hit", hit).where("_hit = 1").select(F.col("author_id").alias("account_id"))
    return whole.union(spanning).distinct()
