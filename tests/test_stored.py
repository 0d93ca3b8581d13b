"""Stored tables, the embedding index, the intake of deliveries and the views of tenants."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradewind.operators.embedding_index import EmbeddingIndex
from tradewind.sources.stored import StoredTable
from tradewind.streaming.intake import DELIVERY, Intake
from tradewind.streaming.outbox import Outbox
from tradewind.tenancy import channel_function, tenant_views

SCHEMA = "id long, value string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, parts=8)
    t.upsert(spark.createDataFrame([(i, "old") for i in range(100)], SCHEMA))
    return t


def test_changes_touch_only_the_parts_they_hit(spark, table):
    before = table.manifest()
    assert len(before) == 8
    touched = table.upsert(spark.createDataFrame([(7, "new"), (1000, "new")], SCHEMA))
    assert 1 <= len(touched) <= 2
    after = table.manifest()
    assert {p for p in before if before[p] != after[p]} == set(touched)
    touched = table.delete(spark.createDataFrame([(7,)], "id long"))
    assert len(touched) == 1 and rows_of(table.read()) == sorted([(i, "old") for i in range(100) if i != 7] + [(1000, "new")], key=str)
    table.insert_ignore(spark.createDataFrame([(1, "new"), (2000, "new")], SCHEMA))
    assert rows_of(table.read().where("id IN (1, 2000)")) == [(1, "old"), (2000, "new")]
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == [] and len(table.versions()) == 4


def test_snapshots_and_what_is_given_up(spark, table):
    for k in range(3):
        table.upsert(spark.createDataFrame([(k, f"v{k}")], SCHEMA))
    assert rows_of(table.read(0)) == sorted([(i, "old") for i in range(100)], key=str)
    assert rows_of(table.read(2).where("id < 3")) == [(0, "v0"), (1, "v1"), (2, "old")]
    want = rows_of(table.read())
    table.forget(keep=1)
    assert rows_of(table.read()) == want and table.versions() == [3]
    with pytest.raises(ValueError, match="no version"):
        table.read(0)


def test_a_crash_leaves_the_old_version(spark, table, monkeypatch):
    want = rows_of(table.read())
    monkeypatch.setattr(StoredTable, "_commit", lambda self, manifest, version: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(spark.createDataFrame([(i, "half") for i in range(50)], SCHEMA))
    monkeypatch.undo()
    assert rows_of(table.read()) == want
    again = StoredTable(spark, table.path, ["id"], SCHEMA, parts=8)
    again.upsert(spark.createDataFrame([(0, "whole")], SCHEMA))
    again.forget()
    assert rows_of(again.read().where("value <> 'old'")) == [(0, "whole")]


def test_a_lost_race_is_an_error(spark, table):
    table._commit(table.manifest(), 1)
    with pytest.raises(RuntimeError, match="somebody else"):
        table._commit(table.manifest(), 1)


def test_replacing_all_rows_of_a_key(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", ["document_id"], "document_id long, ordinal int", parts=4)
    chunks = lambda *pairs: spark.createDataFrame(pairs, "document_id long, ordinal int")
    t.replace(chunks((1, 0), (1, 1), (2, 0)).select("document_id"), chunks((1, 0), (1, 1), (2, 0)))
    t.replace(chunks((1, 0), (3, 0), (2, 0)).select("document_id"), chunks((1, 5), (3, 0)))
    assert rows_of(t.read()) == [(1, 5), (3, 0)]  # the second document has lost its chunks


def test_only_new_contents_are_embedded_and_nothing_is_shuffled(spark, tmp_path):
    index = EmbeddingIndex(spark, f"file://{tmp_path}/e", buckets=4)
    chunk = "document_id long, ordinal int, content string"
    first = index.store(spark.createDataFrame([(i, 0, f"text {i % 30}") for i in range(100)] + [(200, 0, "!!"), (201, 0, "!!")], chunk))
    assert index.embed(first, 1) == 31 and index.embed(first, 2) == 0
    second = index.store(spark.createDataFrame([(i, 0, f"text {i % 33}") for i in range(100)], chunk))
    plan = index.pending(second)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert index.embed(second, 3) == 3
    got = index.embedded(second).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in got} == {1: 91, 3: 9}
    assert index.embedded(first).where("embedding IS NULL").count() == 2
    assert "Exchange" not in index.embedded(second)._jdf.queryExecution().executedPlan().toString()


def test_one_chunk_table_is_embedded_in_two_runs_and_joined_without_its_vectors(spark, tmp_path):
    index = EmbeddingIndex(spark, f"file://{tmp_path}/e")
    assert index.buckets >= 4 * spark.sparkContext.defaultParallelism
    chunks = index.store(spark.createDataFrame([(i, 0, f"text {i % 30}") for i in range(60)] + [(100, 0, "!!")], "document_id long, ordinal int, content string"))
    assert index.embed(chunks, 1, "document_id % 10 <> 0") == 27 and index.embed(chunks, 2) == 4
    filled = F.coalesce(F.size(F.filter("embedding", lambda x: x != 0)), F.lit(0))
    brief = index.embedded(chunks, n=filled)
    assert "embedding" not in brief.columns
    assert rows_of(brief.select("document_id", "run", "n")) == rows_of(index.embedded(chunks).select("document_id", "run", filled))
    assert {r.document_id for r in brief.where("run = 2").collect()} == {0, 10, 20, 30, 40, 50, 100}


def test_only_the_first_look_at_a_lot_takes_a_task_for_every_part_of_the_state(spark, tmp_path):
    intake = Intake(spark, f"file://{tmp_path}/in", late="30 days")
    rows = spark.createDataFrame([(f"m{i}", "telegram", f'{{"message": {{"chat": {{"id": "u{i}"}}, "text": "t{i}", "date": {i}}}}}', datetime(2024, 1, 1, 0, i), None) for i in range(20)], DELIVERY)
    intake.deliver(rows.coalesce(1))
    seen = []
    write = intake.out.write
    intake.out.write = lambda batch, tables: (seen.extend(t.rdd.getNumPartitions() for t in tables.values()), write(batch, tables))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        intake.run(files_per_batch=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert seen and max(seen) < 64
    assert intake.table("events").count() == 20 and not list(tmp_path.glob("in/lots/*"))


def lots(spark, n=40):
    dice = random.Random(2)
    start = datetime(2024, 1, 1)
    tele = [(f"m{i}", "telegram", f'{{"message": {{"chat": {{"id": "u{i}"}}, "text": "t{i}", "date": {i}}}}}', start + timedelta(minutes=i), None) for i in range(n)]
    bank = [(f"t{i}", "bank", f'{{"id": {i // 2}, "transferAmount": 5, "content": "INV {i:08X}", "transferType": "in"}}', start + timedelta(minutes=i), i) for i in range(n)]
    rows = tele + bank + [(None, "bank", "{}", start, 900), (None, "bank", "{}", start, 901)]
    dice.shuffle(rows)
    again = dice.sample(rows[: n // 2], 9)
    make = lambda x: spark.createDataFrame(x, DELIVERY).coalesce(1)
    return rows, [make(rows[: n // 2]), make(rows[n // 2 :]), make(again)]


@pytest.mark.parametrize("crash", [False, True])
def test_deliveries_are_taken_once(spark, tmp_path, monkeypatch, crash):
    intake = Intake(spark, f"file://{tmp_path}/i")
    rows, parts = lots(spark)
    for part in parts:
        intake.deliver(part)
    if crash:
        mark, calls = Outbox.mark, []

        def dying(self, batch):
            calls.append(batch)
            if len(calls) == 2:
                raise RuntimeError("killed")
            mark(self, batch)

        monkeypatch.setattr(Outbox, "mark", dying)
        with pytest.raises(Exception, match="killed"):
            intake.run()
        assert intake.out.marked() == [0]
        monkeypatch.undo()
    intake.run()
    named = {r[0] for r in rows if r[0]}
    assert sorted(r.text for r in intake.table("events").collect()) == sorted(f"t{i[1:]}" for i in named if i[0] == "m")
    got = [r.row_id for r in intake.table("transfers").collect()]
    assert {900, 901} <= set(got) and sorted(r for r in got if r < 900) == list(range(40))


def test_views_of_tenants(spark):
    rows = spark.range(12).select("id", (F.col("id") % 3).cast("int").alias("organization_id"), F.lit("web").alias("kind"), F.concat(F.lit('{"k":"p'), (F.col("id") % 2).cast("string"), F.lit('"}')).alias("config"))
    tenant_views(spark, {"my_rows": rows})
    channel_function(spark, "my_rows", "my_key")
    assert spark.sql("SELECT * FROM my_rows").count() == 0 and spark.sql("SELECT * FROM my_key('k', 'p1')").count() == 0
    spark.sql("SET VAR tenant_id = 1")
    mine = spark.sql("SELECT id FROM my_rows")
    spark.sql("SET VAR tenant_id = 2")
    assert sorted(r.id for r in mine.collect()) == [1, 4, 7, 10]
    assert sorted(r.id for r in spark.sql("SELECT id FROM my_key('k', 'p1')").collect()) == [5, 11]
    spark.sql("SET VAR tenant_id = NULL")
