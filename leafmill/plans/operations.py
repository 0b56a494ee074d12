"""Queries over files, users, jobs, retention and assets, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from ..operators import docx, records, retention, routing
from .surrogates import NOW, job_events, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HEADERS = [
    ("255044462D312E37", "a.pdf", "application/pdf", "opendataloader_ocr"), ("89504E470D0A1A0A00", "b.bin", "image/png", "rapidocr"),
    ("FFD8FFE0", "c.jpg", "image/jpeg", "rapidocr"), ("49492A0008", "d.tif", "image/tiff", "rapidocr"), ("4D4D002A00", "e.tif", "image/tiff", "rapidocr"),
    ("524946460000000057454250", "f.webp", "image/webp", "rapidocr"), ("524946460000000057415645", "g.wav", None, "unsupported"),
    ("D0CF11E0A1B11AE1", "h.DOC", "application/msword", "mammoth_word"), ("D0CF11E0A1B11AE1", "h.xls", None, "unsupported"),
    ("504B0304", "dir/i.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "mammoth_word"), ("504B0304", "i.zip", None, "unsupported"),
]


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


@query(f"SELECT * FROM ({_values([(n, h[1].split('/')[-1], h[2], h[3], None if h[2] else 'UNSUPPORTED_FILE_TYPE') for n, h in enumerate(HEADERS)])}) t(id, name, media_type, engine, error)")
def route_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, h[0], h[1]) for n, h in enumerate(HEADERS)], "id int, hex string, name string")
    typed = rows.withColumn("media_type", routing.media_type(F.unhex("hex"), F.col("name")))
    return typed.select("id", routing.safe_name(F.col("name"), F.col("media_type")).alias("name"), "media_type", routing.engine_of(F.col("media_type")).alias("engine"),
        routing.upload_error(F.lit(10), F.col("media_type")).alias("error"))


_GOOD = [("[Content_Types].xml", 0, 100, 50), ("word/document.xml", 0, 1000, 100)]
ARCHIVES = [
    (_GOOD, None), ([*_GOOD, ("../x", 0, 1, 1)], "unsafe member path"), ([*_GOOD, ("C:\\x", 0, 1, 1)], "unsafe member path"), ([_GOOD[0], *_GOOD], "duplicate members"),
    ([*_GOOD, ("a", 1, 1, 1)], "encrypted"), ([*_GOOD, ("a", 0, 200 << 20, 150 << 20)], "member exceeds the limit"),
    ([*_GOOD, *[(f"a{i}", 0, 100 << 20, 50 << 20) for i in range(3)]], "exceeds the uncompressed limit"), ([*_GOOD, ("a", 0, 501, 1)], "suspicious compression ratio"),
    ([*_GOOD, ("a", 0, 1, 0)], "suspicious compression ratio"), (_GOOD[:1], "not a word document"),
]


@query(f"SELECT * FROM ({_values([(n, a[1]) for n, a in enumerate(ARCHIVES)])}) t(doc_id, error)")
def zip_rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, k, *m) for n, (members, _) in enumerate(ARCHIVES) for k, m in enumerate(members)]
    return docx.zip_rules(spark.createDataFrame(rows, "doc_id int, seq int, name string, flag_bits int, file_size long, compress_size long"))


@query(f"SELECT * FROM ({_values([('text,json', 'json,text'), (' HTML , html', 'html'), ('pdf', None), ('', None)])}) t(asked, formats)")
def format_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("text,json",), (" HTML , html",), ("pdf",), ("",)], "asked string")
    return rows.select("asked", F.array_join(routing.parse_formats(F.col("asked")), ",").alias("formats"))


_RECORDS = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as user_id", "o_orderdate as created_at", "o_orderstatus as status")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "c_name as username", "lower(c_mktsegment) || c_custkey || '@example.org' as email", "c_acctbal > 0 as active")


@query(f"WITH r AS ({_RECORDS}) SELECT id, status FROM r WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 2")
def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page_of(_records(spark, sf_dir), "user_id", 7, ["created_at", "id"], 10, 2).select("id", "status")


@query(f"WITH r AS ({_RECORDS}) SELECT c_custkey AS user_id, count(id) AS n FROM customer LEFT JOIN r ON user_id = c_custkey GROUP BY c_custkey")
def records_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.counts_by_user(_users(spark, sf_dir), _records(spark, sf_dir), "user_id")


@query(f"""
WITH r AS ({_RECORDS}) SELECT c_custkey AS user_id, count(id) AS n_records, count(id) FILTER (status = 'O') AS n_active FROM customer LEFT JOIN r ON user_id = c_custkey GROUP BY c_custkey
""")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, rows = _users(spark, sf_dir), _records(spark, sf_dir)
    counted = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("status") == "O").alias("b"))
    return users.select("user_id").join(counted, "user_id", "left").select("user_id", F.coalesce("a", F.lit(0)).alias("n_records"), F.coalesce("b", F.lit(0)).alias("n_active"))


@query(f"WITH r AS ({_RECORDS}) SELECT c_custkey AS user_id, count(id) FILTER (status = 'O') AS n, count(id) FILTER (status = 'O') >= 10 AS at_limit FROM customer LEFT JOIN r ON user_id = c_custkey GROUP BY 1")
def key_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.at_limit(_users(spark, sf_dir), _records(spark, sf_dir), "user_id", F.col("status") == "O")


@query("SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def owned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()
    return records.owned(jobs, _records(spark, sf_dir).withColumnRenamed("id", "job_id"), 7)


_LOGINS = [f"CUSTOMER#{n:09d}" for n in range(1, 21)]


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey BETWEEN 1 AND 20 AND c_acctbal > 0")
def login_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty users log in, by names in other letters than theirs; those that aren't active get nothing."""
    return reduce(DataFrame.unionByName, [records.login(_users(spark, sf_dir), name) for name in _LOGINS]).select("user_id")


@query(f"SELECT event_id FROM events JOIN customer ON c_custkey = user_id WHERE floor(epoch(ts)) + {7 * DAY} > {NOW} AND c_acctbal > 0")
def valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are sessions that last a week."""
    expires = F.unix_timestamp(F.col("ts").cast("timestamp")) + 7 * DAY
    sessions = table(spark, sf_dir, "events").select("event_id", "user_id", expires.alias("expires_at"))
    return records.valid_sessions(sessions, _users(spark, sf_dir), F.lit(NOW)).select("event_id")


@query("SELECT o_orderkey AS key_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 0")
def valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are keys, active while they are open."""
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("revoked")
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), status.alias("status"))
    return records.valid_keys(keys, _users(spark, sf_dir)).select("key_id")


@query("SELECT o_orderkey AS job_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("modified_at"))
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return retention.orphans(results, jobs, F.lit(NOW + 10_000 * DAY)).select("job_id")


_EVENTS = "SELECT event_id, 'job_' || user_id AS job_id, ['queued', 'processing', 'succeeded', 'failed', 'expired'][event_id % 5 + 1] AS status, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at FROM events"
_LATEST = f"WITH e AS ({_EVENTS}), s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_id DESC) AS k FROM e), j AS (SELECT * FROM s WHERE k = 1) "


@query(_LATEST + "SELECT job_id, status, updated_at FROM j")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.latest_states(job_events(spark, sf_dir), "job_id", "updated_at", "event_id").select("job_id", "status", "updated_at")


@query(f"""
WITH e AS ({_EVENTS}) SELECT event_id, CASE WHEN {NOW} - updated_at <= {DAY} THEN 'keep' WHEN status = 'expired' THEN 'delete' ELSE 'expire' END AS action FROM e
""")
def job_retention_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = job_events(spark, sf_dir).withColumn("modified_at", F.col("updated_at"))
    return retention.job_actions(jobs, F.lit(NOW)).select("event_id", "action")


@query(f"WITH e AS ({_EVENTS}) SELECT count(*) FILTER ({NOW} - updated_at > {DAY} AND status <> 'expired') AS expired_jobs, count(*) FILTER ({NOW} - updated_at > {DAY} AND status = 'expired') AS deleted_job_metadata FROM e")
def cleanup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = job_events(spark, sf_dir).withColumn("modified_at", F.col("updated_at"))
    return retention.report(retention.job_actions(jobs, F.lit(NOW)))


@query(_LATEST + f"""
, u AS (SELECT 'job_' || o_custkey || '.pdf' AS name, o_orderkey AS id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders)
SELECT id, name FROM u WHERE {NOW} - t > {DEFAULTS.stale_seconds} AND NOT EXISTS (SELECT 1 FROM j WHERE job_id || '.pdf' = name AND status IN ('queued', 'processing'))
""")
def stale_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("job_"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("name"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("modified_at"),
    )
    jobs = retention.latest_states(job_events(spark, sf_dir), "job_id", "updated_at", "event_id")
    return retention.stale_uploads(uploads, jobs, F.lit(NOW)).select("id", "name")


@query(f"SELECT event_id FROM events WHERE epoch(ts) + 3600 * (event_id % 48) <= {NOW}")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 3600 * (F.col("event_id") % 48)).alias("expires_at"))
    return retention.expired_sessions(sessions, F.lit(NOW)).select("event_id")


@query("""
WITH s AS (SELECT event_type AS engine, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 360 AS b FROM events),
d AS (SELECT engine, a AS moment, 1 AS step FROM s UNION ALL SELECT engine, b, -1 FROM s), n AS (SELECT engine, moment, sum(step) AS step FROM d GROUP BY engine, moment)
SELECT engine, moment, CAST(sum(step) OVER (PARTITION BY engine ORDER BY moment) AS BIGINT) AS running FROM n
""")
def lease_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("a"))
    return retention.concurrency(spans.withColumn("b", F.col("a") + DEFAULTS.lease_ms // 1000), "engine", "a", "b").withColumnRenamed("at", "moment")


@query(f"""
WITH k(engine, lim) AS (VALUES ('click', 3), ('error', 1), ('none', 2)), a AS (SELECT event_type, count(*) AS n FROM events WHERE (epoch(ts) + 360) > {NOW} GROUP BY 1)
SELECT engine, coalesce(n, 0) AS active, lim AS "limit" FROM k LEFT JOIN a ON event_type = engine
""")
def active_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000 + DEFAULTS.lease_ms).alias("expires_ms"))
    return retention.active_leases(leases, F.lit(NOW * 1000), {"click": 3, "error": 1, "none": 2})


@query("""
WITH f AS (SELECT page_id, 'req ' || (page_id % 10) AS request, url, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url, page_id) AS idx FROM pages),
k AS (SELECT page_id, 'out/' || regexp_replace(request, '[^A-Za-z0-9._-]', '_', 'g') || '/t/' || lpad(CAST(idx AS VARCHAR), 4, '0') || '-' || page_id || '.png' AS object_key FROM f)
SELECT page_id, object_key, rtrim(replace(replace(base64(encode(object_key)), '+', '-'), '/', '_'), '=') AS asset_id, object_key AS decoded FROM k
""")
def asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("req "), (F.col("page_id") % 10).cast("string")).alias("request_id"),
        F.struct("url", "page_id").alias("order"), F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"), F.lit("t").alias("token"))
    from pyspark.sql import Window

    numbered = files.withColumn("idx", F.row_number().over(Window.partitionBy("request_id").orderBy("order")))
    padded = numbered.withColumn("path", F.concat(F.lit("x/"), F.lpad(F.col("idx").cast("string"), 9, "0"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".png"))).drop("idx")
    rows = retention.asset_rows(padded, "out")
    return rows.select("page_id", "object_key", "asset_id", X.decode_key(F.col("asset_id")).alias("decoded"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text")
def asset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.distinct_contents(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS completed_at FROM orders
""")
def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("job_1").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("succeeded").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
    )
    done = rows.withColumn("completed_at", records.completed_at(F.col("status"), F.col("created_at")))
    return records.record_view(done).select(F.col("id").cast("long").alias("id"), "created_at", "completed_at")


@query(_LATEST + """
, a AS (SELECT job_id, status, CAST(substr(job_id, 5) AS BIGINT) AS u FROM j)
SELECT job_id, CASE WHEN u % 3 = 0 THEN 'JOB_NOT_FOUND' WHEN status <> 'succeeded' THEN 'JOB_NOT_READY' WHEN u % 2 = 0 THEN 'RESULT_EXPIRED' END AS error FROM a
""")
def result_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = retention.latest_states(job_events(spark, sf_dir), "job_id", "updated_at", "event_id")
    number = F.substring("job_id", 5, 20).cast("long")
    return records.result_access(jobs, jobs.where(number % 3 != 0), jobs.where(number % 2 != 0))


@query("""
SELECT event_type AS job_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, arg_max(user_id, (ts, event_id)) AS last_user, count(*) AS n FROM events GROUP BY 1, 2
""")
def hourly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("job_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"), F.count(F.lit(1)).alias("n")
    )
