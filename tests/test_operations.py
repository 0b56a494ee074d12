from pyspark.sql import functions as F

from leafmill.config import DEFAULTS
from leafmill.operators import records, retention, routing
from leafmill.sources import engines, files
from leafmill.streaming import jobs


def test_settings():
    s = DEFAULTS.with_overrides({"ocr_concurrency": 4, "unknown": 1, "word_concurrency": None})
    assert (s.ocr_concurrency, s.word_concurrency, s.lease_ms, s.stale_seconds, s.limit_of("ocr")) == (4, 2, 360_000, 3600, 4)


def test_upsert_revoke_register_logout(spark):
    old = spark.createDataFrame([("a", "queued", 1), ("b", "queued", 1)], "k string, status string, v int")
    new = spark.createDataFrame([("a", "failed", 2)], "k string, status string, v int")
    assert {r.k: r.status for r in records.upsert(old, new, "k", "v").collect()} == {"a": "failed", "b": "queued"}
    keys = spark.createDataFrame([(1, 7, "active"), (2, 8, "active")], "id int, user_id int, status string")
    assert {r.id: r.status for r in records.revoke(keys, 2, 7).collect()} == {1: "active", 2: "active"}
    assert {r.id: r.status for r in records.revoke(keys, 1, 7).collect()} == {1: "revoked", 2: "active"}
    users = spark.createDataFrame([(1, "Ann", "a@x.y")], "user_id int, username string, email string")
    more = spark.createDataFrame([(2, "ann", "b@x.y"), (3, "Bob", "c@x.y"), (4, "bob", "d@x.y"), (5, "Cy", "A@x.y")], users.schema)
    free, taken = records.register(users, more)
    assert [r.user_id for r in free.collect()] == [3] and sorted(r.user_id for r in taken.collect()) == [2, 4, 5]
    sessions = spark.createDataFrame([("h1",), ("h2",)], "token_hash string")
    assert [r.token_hash for r in records.logout(sessions, sessions.where("token_hash = 'h1'")).collect()] == ["h2"]


def test_access_and_validation(spark):
    jobs_ = spark.createDataFrame([("job_1", "succeeded"), ("job_2", "queued"), ("job_3", "succeeded"), ("bad", "succeeded")], "job_id string, status string")
    got = {r.job_id: r.error for r in records.result_access(jobs_, jobs_.where("job_id != 'job_9'"), jobs_.where("job_id = 'job_1'")).collect()}
    assert got == {"job_1": None, "job_2": "JOB_NOT_READY", "job_3": "RESULT_EXPIRED", "bad": "JOB_NOT_FOUND"}
    rows = spark.createDataFrame([("a",), ("ab",), ("名字",), ("x y",)], "n string")
    assert [r.v for r in rows.select(records.valid_username(F.col("n")).alias("v")).collect()] == [False, True, True, False]


def test_retention(spark):
    rows = spark.createDataFrame([("a", "succeeded", 0.0, 0.0), ("b", "expired", 0.0, 0.0), ("c", "queued", 90_000.0, 0.0), ("d", None, None, 0.0)], "job_id string, status string, updated_at double, modified_at double")
    got = {r.job_id: r.action for r in retention.job_actions(rows, F.lit(100_000)).collect()}
    assert got == {"a": "expire", "b": "delete", "c": "keep", "d": "delete"}
    uploads = spark.createDataFrame([("job_1.pdf", 0), ("job_2.pdf", 0), ("new.pdf", 99_000)], "name string, modified_at long")
    states = spark.createDataFrame([("job_1", "processing"), ("job_2", "failed")], "job_id string, status string")
    assert [r.name for r in retention.stale_uploads(uploads, states, F.lit(100_000)).collect()] == ["job_2.pdf"]
    assets = spark.createDataFrame([(1, "x", True), (1, "y", False), (2, "z", True)], "result_id int, asset_id string, deleted boolean")
    assert {r.result_id: r.delete for r in retention.deletable_results(assets).collect()} == {1: False, 2: True}


def test_detected_type_and_outputs(spark):
    rows = spark.createDataFrame([("application/pdf", [], 2), ("application/pdf", [1, 2], 2), ("application/pdf", [1], 2), ("image/png", [], 1)], "m string, p array<int>, n int")
    assert [r.t for r in rows.select(routing.detected_type(F.col("m"), F.col("p"), F.col("n")).alias("t")).collect()] == ["text_pdf", "scanned_pdf", "mixed_pdf", "image"]


def test_engines(spark):
    assert engines.available({"a": "json", "b": "no_such_module"}, {"c": "no-such-program"}) == {"a": True, "b": False, "c": False}
    assert records.health({"a": True}, False, False) == "ok" and records.health({"a": True}, True, False) == "degraded"


def test_files_and_stream_agree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (source / "b.txt").write_bytes(b"hello")
    batch = {(r.name, r.status, r.error) for r in jobs.job_rows(files.uploads(spark, str(source))).collect()}
    jobs.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (source / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    jobs.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stream = {(r.name, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert batch == {("a.pdf", "queued", None), ("b.txt", "failed", "UNSUPPORTED_FILE_TYPE")}
    assert stream == batch | {("c.png", "queued", None)}


def test_engine_outputs(spark, tmp_path):
    for doc, name, text in (("d1", "x.md", "m"), ("d1", "x.txt", "t"), ("d2", "y.bin", "?")):
        (tmp_path / doc).mkdir(exist_ok=True)
        (tmp_path / doc / name).write_text(text)
    got = {r.doc: r for r in files.engine_outputs(spark, str(tmp_path)).collect()}
    assert (got["d1"].markdown, got["d1"].text, got["d1"].error) == ("m", "t", None) and got["d2"].error == "ENGINE_UNAVAILABLE"
