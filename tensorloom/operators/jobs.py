"""The job store's queries: listing, ownership, state and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "failed", "cancelled")


def listing(jobs: DataFrame, user: Column, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A user's jobs, newest first, ties by id; a page of them."""
    own = jobs.filter(F.col("user_id") == user)
    own = own if status is None else own.filter(F.col("status") == status)
    return own.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit)


def pages(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """First page of every user at once."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "job_id")
    return jobs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def exists(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(rows.select(*on).distinct(), on, "left_semi")


def valid_tokens(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Tokens neither revoked nor expired, with their users."""
    return tokens.filter(~F.col("revoked") & (F.col("expires_at") > now)).join(users, "user_id")


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after cancellations: only the owner's request counts, and only before a terminal state."""
    asked = requests.select("job_id", "user_id").distinct().withColumn("_asked", F.lit(True))
    joined = jobs.join(asked, ["job_id", "user_id"], "left")
    return joined.withColumn("status", F.when(F.col("_asked") & ~F.col("status").isin(*TERMINAL), "cancelled").otherwise(F.col("status"))).drop("_asked")


def latest_state(events: DataFrame) -> DataFrame:
    """Each job's state after all its events: the last one by time, then by id."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return children.join(parents.select(key).distinct(), key, "left_anti")
