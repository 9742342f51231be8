"""Events joined with what is known about their users."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BUSY_USERS = 200     # any other user has at most a 200th of the events


def one_per_user(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """One profile of each user; of several, the smallest in the order of the columns.

    Profiles without a user are left out.
    """
    own = [c for c in profiles.columns if c != key]
    return (profiles.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min(F.struct(*own)).alias("_own"))
            .select(key, *(F.col("_own").getField(c).alias(c) for c in own)))


def with_profiles(events: DataFrame, profiles: DataFrame, key: str = "user_id",
                  busy_users: int = BUSY_USERS) -> DataFrame:
    """The events with the other columns of ``profiles``; null for users without a profile.

    No event is lost or doubled. Profiles may be of any number: Spark broadcasts them only
    if their measured size allows it, and shuffles both sides by user otherwise. For that
    case the ``busy_users`` users with the most events are looked up apart: their profiles,
    one row each, are broadcast, so their events stay where they are. Events without a
    user need no lookup. Column names of both sides must differ but for the key.
    """
    own = [c for c in profiles.columns if c != key]
    if clash := sorted(set(own) & set(events.columns)):
        raise ValueError(f"events and profiles both have {', '.join(clash)}")
    known = one_per_user(profiles, key)
    named = events.where(F.col(key).isNotNull())
    busy = F.broadcast(named.groupBy(key).agg(F.count("*").alias("_n"))
                       .orderBy(F.col("_n").desc(), key).limit(busy_users).select(key))
    theirs = F.broadcast(known.join(busy, key, "left_semi"))
    blank = [F.lit(None).cast(profiles.schema[c].dataType).alias(c) for c in own]
    parts = (named.join(busy, key, "left_semi").join(theirs, key, "left"),
             named.join(busy, key, "left_anti").join(known, key, "left"),
             events.where(F.col(key).isNull()).select("*", *blank))
    columns = [*events.columns, *own]
    first, *others = (part.select(*columns) for part in parts)
    for part in others:
        first = first.unionByName(part)
    return first
