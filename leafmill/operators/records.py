"""Users, keys, sessions, parse records: the operational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS

#: Patterns of names that users may choose.
USERNAME = r"^[A-Za-z0-9_一-鿿-]{2,32}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
REQUEST_ID = r"^[A-Za-z0-9._:-]{1,128}$"
JOB_ID = r"^job_[A-Za-z0-9_-]{1,64}$"
FINAL = ("succeeded", "failed", "expired")


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key, by these columns in turn; found before the shuffle already, so no key is hot."""
    best = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*newest)).alias("row"))
    return best.select("row.*")


def page_of(rows: DataFrame, user: str, user_id, newest: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a user's rows, newest first; ties by the further columns. The limit is held between 1 and 100."""
    return rows.where(F.col(user) == user_id).orderBy(*[F.col(c).desc() for c in newest]).offset(max(0, offset)).limit(min(100, max(1, limit)))


def counts_by_user(users: DataFrame, rows: DataFrame, user: str, condition: Column | None = None) -> DataFrame:
    """user, n: how many rows (that meet the condition) each user has, 0 included."""
    hit = F.lit(True) if condition is None else condition
    counted = rows.where(hit).groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return users.select(user).join(counted, user, "left").select(user, F.coalesce("n", F.lit(0)).alias("n"))


def at_limit(users: DataFrame, keys: DataFrame, user: str, active: Column, most: int = DEFAULTS.max_active_keys) -> DataFrame:
    return counts_by_user(users, keys, user, active).withColumn("at_limit", F.col("n") >= most)


def login(users: DataFrame, given: str) -> DataFrame:
    """Active users whose mail or name this is, whatever the case."""
    return users.where((F.lower("email") == given.lower()) | (F.lower("username") == given.lower())).where("active")


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now).join(users.where("active"), "user_id")


def valid_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    return keys.where("status = 'active'").join(users.where("active"), "user_id")


def owned(jobs: DataFrame, records: DataFrame, user_id, is_admin: bool = False) -> DataFrame:
    """The jobs that a user's records name; all for an admin."""
    return jobs if is_admin else jobs.join(records.where(F.col("user_id") == user_id).select("job_id").distinct(), "job_id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both; of each key the one of the latest version. Completion is stamped by final states only."""
    return latest(old.unionByName(new, allowMissingColumns=True), key, version)


def completed_at(status: Column, now: Column) -> Column:
    return F.when(status.isin(*FINAL), now)


def revoke(keys: DataFrame, key_id, user_id) -> DataFrame:
    hit = (F.col("id") == key_id) & (F.col("user_id") == user_id)
    return keys.withColumn("status", F.when(hit, F.lit("revoked")).otherwise(F.col("status")))


def register(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users that no name or mail stands against, and those that exist already; of equal new ones the first counts."""
    taken = users.select(F.lower("username").alias("__u"), F.lower("email").alias("__e"))
    names, mails = taken.select("__u").distinct(), taken.select("__e").distinct()
    free = new.join(names, F.lower("username") == F.col("__u"), "left_anti").join(mails, F.lower("email") == F.col("__e"), "left_anti")
    first = lambda df, c: df.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower(c)).orderBy("user_id"))).where("__n = 1").drop("__n")
    free = first(first(free, "username"), "email")
    return free, new.join(free.select("user_id"), "user_id", "left_anti")


def logout(sessions: DataFrame, token_hashes: DataFrame) -> DataFrame:
    return sessions.join(token_hashes.select("token_hash"), "token_hash", "left_anti")


def bootstrap_admins(users: DataFrame, names: list[str]) -> DataFrame:
    return users.withColumn("is_admin", F.lower("username").isin(*[n.casefold() for n in names]) if names else F.lit(False))


def record_view(records: DataFrame) -> DataFrame:
    """Ids as strings, times in ISO form with Z, the error only where there is a code."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")))
    return records.select(F.col("id").cast("string").alias("id"), "job_id", "status", iso("created_at").alias("created_at"), iso("completed_at").alias("completed_at"), error.alias("error"))


def result_access(jobs: DataFrame, owned_ids: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, error: 404 for others' jobs, 409 before success, 410 when the result is gone, else null."""
    mine = owned_ids.select("job_id").distinct().withColumn("mine", F.lit(True))
    there = results.select("job_id").distinct().withColumn("there", F.lit(True))
    error = F.when(F.col("mine").isNull() | ~F.col("job_id").rlike(JOB_ID), "JOB_NOT_FOUND").when(F.col("status") != "succeeded", "JOB_NOT_READY").when(F.col("there").isNull(), "RESULT_EXPIRED")
    return jobs.join(mine, "job_id", "left").join(there, "job_id", "left").select("job_id", error.alias("error"))


def valid_username(x: Column) -> Column:
    return F.trim(x).rlike(USERNAME)


def valid_email(x: Column) -> Column:
    return F.lower(F.trim(x)).rlike(EMAIL)


def request_id(x: Column) -> Column:
    return F.when(x.rlike(REQUEST_ID), x).otherwise(F.uuid())


def health(engines: dict[str, bool], database_configured: bool, database_ok: bool) -> str:
    """ok if every engine is there and the database, if there should be one, answers."""
    return "ok" if all(engines.values()) and (database_ok or not database_configured) else "degraded"
