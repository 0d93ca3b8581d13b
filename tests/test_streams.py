"""Jobs that fail and are replayed, keyed state over several micro-batches."""

from datetime import datetime, timedelta

import pytest
from compare import same
from pyspark.sql import functions as F

from tradewind.operators.scans import first_hit_windows
from tradewind.plans import state  # noqa: F401
from tradewind.plans.catalog import ORACLES, QUERIES
from tradewind.sources import readers
from tradewind.streaming import events, stateful
from tradewind.streaming.jobs import GONE, JobLog
from tradewind.streaming.outbox import Outbox

FILES = "document_id long, name string, content binary, from_attempt int"
TEXT = ("one line\n\n" * 200).encode()


def log_of(spark, tmp_path):
    log = JobLog(spark, f"file://{tmp_path}/jobs")
    files = spark.createDataFrame([(1, "a.txt", TEXT, 1), (2, "b.txt", b"  ", 1), (3, "c.pdf", b"x", 1), (4, "d.txt", b"late", 2), (5, "e.json", b'{"k": 1}', None), (6, "f.docx", b"broken", 1)], FILES)
    for lot in ([(10, "ingest_document", 1), (11, "ingest_document", 2)], [(12, "ingest_document", 3), (13, "embed_document", 4)], [(14, "ingest_document", 5), (15, "ingest_document", 6), (16, "shred", 1), (17, None, 1), (18, "ingest_document", 99)]):
        log.enqueue(spark.createDataFrame(lot, "job_id long, kind string, document_id long").coalesce(1))
    return log, files


def settled(log):
    return {r.job_id: (r.status, r.attempts) for r in log.status().collect()}


def check(log):
    assert settled(log) == {10: ("ready", 1), 11: ("error", 3), 12: ("error", 3), 13: ("ready", 2), 14: ("ready", 1), 15: ("error", 3), 16: ("error", 3), 17: ("error", 3), 18: ("error", 3)}
    tries = [(r.job_id, r.attempt) for r in log.tries().collect()]
    assert len(tries) == len(set(tries)) == 3 + 1 + 3 * 6  # 10, 14; 13 twice; six jobs three times
    errors = {r.job_id: r.error for r in log.dead().collect()}
    assert errors[18] == GONE and errors[16] == "unknown job kind: shred" and set(errors) == {11, 12, 15, 16, 17, 18}
    chunks = log.chunks().where("job_id = 10").orderBy("ordinal").collect()
    assert "\n\n".join(c.content for c in chunks) == TEXT.decode().strip() and log.chunks().groupBy("job_id", "ordinal").count().where("count > 1").isEmpty()
    assert [r.status for r in log.history().where("job_id = 13").orderBy("step").collect()] == ["pending", "processing", "error", "processing", "ready"]


def test_jobs_fail_and_are_tried_again(spark, tmp_path):
    log, files = log_of(spark, tmp_path)
    assert set(s for s, _ in settled(log).values()) == {"pending"}
    assert log.run(files, 1) >= 3
    assert settled(log)[13] == ("error", 1)
    log.drain(files)
    check(log)
    log.drain(files)  # nothing is left
    check(log)


@pytest.mark.parametrize("step", ["work", "mark"])
def test_a_killed_run_counts_every_attempt_once(spark, tmp_path, monkeypatch, step):
    log, files = log_of(spark, tmp_path)
    place = JobLog if step == "work" else Outbox
    real, calls = getattr(place, step), []

    def dying(self, *args):
        calls.append(1)
        if len(calls) == 2:
            if step == "work":
                real(self, *args)  # all is written, the stream does not know it
            raise RuntimeError("killed")
        return real(self, *args)

    monkeypatch.setattr(place, step, dying)
    with pytest.raises(Exception, match="killed"):
        log.run(files, 1)
    if step == "mark":
        assert {r.batch for r in log.tries().collect()} == {0}  # what is not marked is not seen
    monkeypatch.undo()
    JobLog(spark, log.path).drain(files, 1)
    check(log)


def slices(spark, df, order, n, path):
    """df as n files whose order of arrival is that of the column."""
    at = df.withColumn("_slice", F.ntile(n).over(events_window(order)))
    for i in range(1, n + 1):
        at.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events_window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def test_conversations_over_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, [1, 1, 2, None][i % 4], f"u{i % 3}" if i % 7 else None, [None, "", "Ann", "Bo"][(i * 7) % 4], start + timedelta(minutes=i // 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, channel_id int, customer_ref string, customer_name string, created_at timestamp_ntz")
    with stateful.on_disk_state(spark):
        got = events.run_to_table(stateful.conversations(slices(spark, df, ["created_at", "id"], 4, f"file://{tmp_path}/in")), "conversations").collect()
    seen, want = {}, {}
    for i, channel, ref, name, _ in rows:
        made = (channel, ref) not in seen
        conversation, known = seen.get((channel, ref), (i, None))
        seen[channel, ref] = (conversation, known or name or None)
        want[i] = (channel, ref, *seen[channel, ref], made)
    assert {r.id: tuple(r)[1:] for r in got} == want


def test_windows_close_by_hits_and_by_timers(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    end = df.agg(F.max("ts")).first()[0]
    clock = spark.createDataFrame([(-1, end + timedelta(days=2))], df.schema)  # moves the watermark past all windows but its own
    with stateful.on_disk_state(spark):
        stream = stateful.first_hits(slices(spark, df.unionByName(clock), ["ts"], 3, f"file://{tmp_path}/in"), 2, 6 * 3600)
        got = events.run_to_table(stream, "first-hits")
    key = lambda r: (r.user_id, r.window_start, r.hits, r.allowed)
    assert sorted(map(key, got.collect())) == sorted(map(key, first_hit_windows(df, 2, 6 * 3600).collect()))


def test_stored_files_are_not_shuffled_again(spark, tmp_path):
    log = JobLog(spark, f"file://{tmp_path}/log")
    files = log.stored(spark.createDataFrame([(i, f"{i}.txt", f"text {i}".encode(), 1) for i in range(50)], "document_id long, name string, content binary, from_attempt int"))
    jobs = spark.createDataFrame([(i, "ingest_document", i, 1) for i in range(60)], "job_id long, kind string, document_id long, attempt int")
    joined = jobs.hint("shuffle_hash").join(files, "document_id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r.job_id: (r.text, r.error) for r in log._worked(jobs, files).collect()}
    assert got == {i: (f"text {i}", None) if i < 50 else (None, "the uploaded file was not found") for i in range(60)}


def test_attempts_of_documents_without_a_text(spark, tmp_path):
    """A document's file is there by its number, whatever its text is."""
    import duckdb

    texts = [None, "", "  \n ", "one", "two words", None, "\u00a0", "x", "y", "z", "\ufeff", "last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(QUERIES["ingest_attempts"](spark, str(tmp_path)), con, ORACLES["ingest_attempts"])


def test_a_lack_of_memory_is_no_broken_file(spark):
    def reader(raw):
        raise MemoryError

    files = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(Exception, match="MemoryError"):
        readers.extracted(files, pdf=reader).collect()
