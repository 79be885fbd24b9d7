"""Ratings rolled up into one score, and usage rolled up against limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights, the mean that weak scores are drawn to, and the votes that make a score full.
CRITIC_WEIGHT, MEAN, USER_VOTES, CRITIC_VOTES, UNKNOWN_USER, UNKNOWN_CRITIC, NO_CRITIC = 0.6, 70.0, 400.0, 5.0, 0.5, 1.0, 0.6


def vote_confidence(critic: Column, votes: Column) -> Column:
    known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), votes / F.when(critic, CRITIC_VOTES).otherwise(USER_VOTES)))
    return F.when(votes.isNull(), F.when(critic, UNKNOWN_CRITIC).otherwise(UNKNOWN_USER)).otherwise(known)


def bayes(ratings: DataFrame, key: str, critic_weight: float = CRITIC_WEIGHT, mean: float = MEAN, no_critic: float = NO_CRITIC) -> DataFrame:
    """universal, critic and user score (0 to 100) of each key, from ratings (kind, score, votes).

    A score counts by its confidence and is drawn to the mean by what it lacks; a key that no critic has
    scored is drawn once more. Weights are summed as integers of 1e-6, so that no order of rows matters.
    """
    critic = F.col("kind") == "critic"
    c = vote_confidence(critic, F.col("votes"))
    adjusted = c * F.col("score") + (1 - c) * mean
    weight = F.when(critic, critic_weight).otherwise(1 - critic_weight) * c
    whole = lambda x: F.bround(x * 1e6, 0).cast("long")
    rows = ratings.filter("score is not null").select(key, critic.alias("_c"), whole(weight).alias("_w"), whole(weight * adjusted).alias("_wa"))
    sums = rows.groupBy(key).agg(*(F.sum(F.when(on, F.col(c)).otherwise(F.lit(0))).alias(f"{c}{n}") for c in ("_w", "_wa") for n, on in (("", F.lit(True)), ("_critic", F.col("_c")), ("_user", ~F.col("_c")))))
    mean_of = lambda n: F.when(F.col(f"_w{n}") > 0, F.col(f"_wa{n}") / F.col(f"_w{n}"))
    drawn = F.when(F.col("_w_critic") > 0, mean_of("")).otherwise(no_critic * mean_of("") + (1 - no_critic) * mean)
    return sums.filter("_w > 0").select(key, *(F.bround(x, 0).cast("int").alias(n) for n, x in (("universal", drawn), ("critic", mean_of("_critic")), ("user", mean_of("_user")))))


def dense_daily(rows: DataFrame, day: str, value: str, first: str, last: str) -> DataFrame:
    """A row for each day from first to last, zero where nothing happened."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    sums = rows.groupBy(day).agg(F.sum(value).alias(value))
    return days.join(sums, day, "left").select(day, F.coalesce(value, F.lit(0)).alias(value))


def verdict(used: Column, limit: Column, unpriced: Column | None = None) -> Column:
    """over, at or under a limit; none without one; blocked where a price is missing."""
    plain = F.when(limit.isNull(), "none").when(used > limit, "over").when(used == limit, "at").otherwise("under")
    return plain if unpriced is None else F.when(limit.isNotNull() & unpriced, "blocked").otherwise(plain)


def enforced(usage: DataFrame, caps: DataFrame, pending: DataFrame) -> DataFrame:
    """(scope, key, hit) for each row of caps: which of its limits stops the next call, null where none does.

    usage: scope, key, total, input, output, cents, unpriced (whether something used has no price); caps: the same names
    as limits, null or 0 for none; pending: scope, key of calls about to be made without a price. Any limit is enough,
    in the order total, input, output, price, budget; a budget that can't be measured stops, as it can't be kept.
    """
    used = usage.select("scope", "key", *(F.col(c).alias(f"_{c}") for c in ("total", "input", "output", "cents", "unpriced")))
    rows = caps.join(used, ["scope", "key"], "left").join(pending.select("scope", "key", F.lit(True).alias("_pending")).distinct(), ["scope", "key"], "left")
    over = lambda c: (F.coalesce(c, F.lit(0)) > 0) & (F.coalesce(F.col(f"_{c}"), F.lit(0)) >= F.col(c))
    budget = F.coalesce("cents", F.lit(0)) > 0
    hit = F.when(over("total"), "total").when(over("input"), "input").when(over("output"), "output").when(budget & F.col("_pending"), "unpriced call").when(budget & F.col("_unpriced"), "unpriced usage").when(over("cents"), "budget")
    return rows.select("scope", "key", hit.alias("hit"))
