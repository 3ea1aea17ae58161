"""Accounts, refresh tokens and jobs: writes as new tables, look-ups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows and those new ones whose key isn't there yet; a key that comes twice is kept twice, as a table's constraint would tell."""
    return rows.unionByName(new.join(rows.select(*key).distinct(), key, "left_anti").select(*rows.columns))


def logged_in(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users with ``last_login_at`` moved on to their latest log-in (user_id, at)."""
    latest = logins.groupBy("user_id").agg(F.max("at").alias("_at"))
    return users.join(latest, "user_id", "left").withColumn("last_login_at", F.greatest("last_login_at", "_at")).drop("_at")


def issued(tokens: DataFrame) -> DataFrame:
    """Refresh tokens as they are stored: the SHA-256 of each, never the token."""
    return tokens.withColumn("token_hash", F.sha2(F.col("token"), 256)).drop("token")


def revoked(tokens: DataFrame, hashes: DataFrame) -> DataFrame:
    """Tokens after those of the given hashes (token_hash) were revoked."""
    gone = hashes.select("token_hash").distinct().withColumn("_gone", F.lit(True))
    return tokens.join(gone, "token_hash", "left").withColumn("revoked", F.col("revoked") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def queued(requests: DataFrame) -> DataFrame:
    """New jobs of requests (job_id, user_id, source, target, at)."""
    return requests.select("job_id", "user_id", F.lit("queued").alias("status"), F.col("at").alias("created_at"), "source", "target")


def by_key(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of the keys asked for (users by id or email, jobs by id); unknown keys give none."""
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def owners(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """(job_id, user_id, owner, status, own) of the jobs that users ask for; unknown jobs give no row."""
    found = jobs.select("job_id", F.col("user_id").alias("owner"), "status")
    return asked.join(found, "job_id").withColumn("own", F.col("user_id") == F.col("owner"))


def downloads(jobs: DataFrame) -> DataFrame:
    """(user_id, job_id, output_path) of finished jobs: what each owner may fetch."""
    return jobs.filter((F.col("status") == "done") & F.col("output_path").isNotNull()).select("user_id", "job_id", "output_path")


def healthy(jobs: DataFrame) -> DataFrame:
    """One row: whether the store answers."""
    return jobs.limit(1).agg((F.count("*") >= 0).alias("ok"))
