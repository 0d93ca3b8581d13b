"""Hand-made cases for rules that the queries over the test tables do not corner."""

import io
import random
import time
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tradewind.functions import signatures
from tradewind.functions.scalars import number_text, stale
from tradewind.functions import text
from tradewind.functions.text import trigrams
from tradewind.operators import billing, ingest, retrieval
from tradewind.plans import catalog, content  # noqa: F401
from tradewind.sources import readers, sinks, webhooks
from tradewind.streaming import events
from tradewind.tenancy import TenantContext


def test_tenants_part_the_rows(spark):
    df = spark.range(100).withColumn("organization_id", (F.col("id") % 5).cast("int"))
    parts = [TenantContext(o).visible(df) for o in range(5)]
    assert sum(p.count() for p in parts) == 100
    assert TenantContext().visible(df).count() == 0
    assert TenantContext(admin=True).visible(df).count() == 100
    with pytest.raises(Exception, match="another tenant"):
        TenantContext(1).checked(df).collect()


def test_trigrams(spark):
    assert spark.range(1).select(trigrams(F.lit("Cat")).alias("t")).first().t == ["  c", " ca", "cat", "at "]


def test_rank_fusion_prefers_agreement(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1)], "query long, id long, score double, rank int")
    lexical = spark.createDataFrame([(1, 11, 0.7, 0), (1, 12, 0.6, 1)], "query long, id long, score double, rank int")
    top = retrieval.fused(dense, lexical, 3).orderBy("place").collect()
    assert [r.id for r in top] == [11, 10, 12] and [r.kw for r in top] == [True, False, True]
    assert top[0].score == pytest.approx(1 / 62 + 1 / 61) and top[2].vscore == 0


def test_chunks(spark):
    text = "\n\n".join(f"p{i} " + "x" * 90 for i in range(10))
    got = spark.range(1).select(ingest.chunks_of(F.lit(text), target=300).alias("c")).first().c
    assert all(len(c) <= 300 for c in got) and "\n\n".join(got) == text
    one = lambda t, **k: spark.range(1).select(ingest.chunks_of(F.lit(t), **k).alias("c")).first().c
    assert one("y" * 900) == ["y" * 800]
    assert "".join(one("y" * 1900, lossless=True)) == "y" * 1900
    assert one("  ") == ["  "]


def plain_chunks(text, target, gap, lossless):
    parts = [p for p in map(str.strip, text.replace("\r", "").split(gap)) if p]
    if lossless:
        parts = [p[i : i + target] for p in parts for i in range(0, len(p), target)]
    out = []
    for p in parts:
        if out and len(out[-1]) + len(gap) + len(p) <= target:
            out[-1] += gap + p
        else:
            out.append(p[:target])
    return out or [text[:target]]


def test_chunks_equal_the_plain_version(spark):
    dice = random.Random(1)
    texts = ["".join(dice.choice(["ab", "c d", "\n", "\n\n", " ", "x" * 17, "\r\n", "é😀"]) for _ in range(dice.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for lossless in (False, True):
        for gap in ("\n", "\n\n"):
            got = [r.c for r in rows.select(ingest.chunks_of(F.col("t"), 30, gap, lossless).alias("c")).collect()]
            assert got == [plain_chunks(t, 30, gap, lossless) for t in texts]


def test_chunking_takes_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        chunks = ingest._packed("some words on a line\n" * n, 800, "\n", False)
        took.append(time.perf_counter() - began)
        assert len(chunks) == -(-n // 38)
    assert took[1] < 12 * took[0] + 0.05


def test_readers(spark):
    docx = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    xlsx = io.BytesIO()
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>k</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>')
    files = [("a.txt", b"plain"), ("b.json", b'{"x": 1}'), ("c.html", b"<p>T</p><script>no</script><!-- no -->"), ("d.docx", docx.getvalue()), ("e.xlsx", xlsx.getvalue()), ("f.txt", b"  "), ("g.zip", b"\xff\xfeh\x00i\x00"), ("h.pdf", b"x"), ("i.docx", b"broken")]
    got = {r.path: r for r in readers.extracted(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.txt"].text == "plain" and got["b.json"].text == '{\n  "x": 1\n}' and got["c.html"].text == "T"
    assert got["d.docx"].text == "Hello\na | b" and got["e.xlsx"].text == "# S\nk | 3" and got["g.zip"].text.endswith("hi")
    assert all(got[k].text is None and got[k].error for k in ("f.txt", "h.pdf", "i.docx"))


def test_transfers_are_read_leniently(spark):
    bodies = ['{"id": 7, "transferAmount": 5.5, "content": "INV 00000012", "transferType": "IN"}', "id=8&content=a+b&transferType=in", "", None, "{broken"]
    got = webhooks.transfers(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.txn_id, r.amount, r.memo, r.transfer_type) for r in got] == [(7, 5.5, "INV 00000012", "in"), (8, 0.0, "a b", "in"), (None, 0.0, "", ""), (None, 0.0, "", ""), (None, 0.0, "", "")]


def test_broken_webhooks_give_no_rows(spark):
    raw = spark.createDataFrame([("meta", "no json"), ("telegram", "{}"), ("zalo", None), ("whatsapp", '{"entry": []}')], "kind string, payload string")
    assert webhooks.normalised(raw).count() == 0


TRANSFER = "row_id long, txn_id long, amount double, memo string, transfer_type string, created_at timestamp_ntz"


def transfers_of(spark, rows):
    return spark.createDataFrame([(*r, datetime(2024, 1, 1, 0, r[0] % 60)) for r in rows], TRANSFER)


def test_reconcile_takes_the_least_invoice_and_only_incoming(spark):
    inv = spark.createDataFrame([(12, 1, "pending"), (13, 2, "submitted"), (14, 3, "paid")], "id long, account_id long, status string")
    rows = [(1, 1, 5.0, "QR0000000d inv-0000 000C", "in"), (2, 2, 5.0, "INV0000000C", "out"), (3, 3, 5.0, "INV0000000E", "in"), (4, 4, 5.0, None, ""), (5, 5, 5.0, "QRINV0000000D", "")]
    got = {r.row_id: r.matched_invoice for r in billing.reconcile(transfers_of(spark, rows), inv).collect()}
    assert got == {1: 12, 2: None, 3: None, 4: None, 5: 13}


def test_a_transaction_id_pays_once(spark):
    inv = spark.createDataFrame([(12, 1, "pending"), (13, 2, "pending")], "id long, account_id long, status string")
    rows = [(1, 7, 5.0, "thanks", "in"), (2, 7, 5.0, "INV0000000C", "in"), (3, None, 5.0, "INV0000000D", "in"), (4, None, 5.0, "INV0000000D", "in")]
    got = {r.row_id: (r.named_invoice, r.matched_invoice) for r in billing.reconcile(transfers_of(spark, rows), inv).collect()}
    assert got == {1: (None, None), 3: (13, 13), 4: (13, None)}  # row 2 repeats an id; row 4 comes too late


@pytest.mark.parametrize("seed", range(3))
def test_reconcile_equals_taking_transfers_one_by_one(spark, seed):
    """Memos with up to four codes, few accounts, so that transfers get in each other's way."""
    dice = random.Random(seed)
    invoices = [(i, dice.randrange(8), dice.choice(["pending", "submitted", "paid"])) for i in range(1, 41)]
    rows = [(n, dice.choice([None, dice.randrange(30)]), 1.0, " ".join(f"inv {dice.randrange(1, 41):08x}" for _ in range(dice.randrange(5))), dice.choice(["in", "", "out"])) for n in range(60)]
    seen, taken, want = set(), set(), {}
    for row, txn, _, memo, kind in rows:
        if txn is not None and txn in seen:
            continue
        seen.add(txn)
        named = sorted(int(code, 16) for code in memo.split() if code != "inv") if kind != "out" else []
        hits = [i for i in named if invoices[i - 1][2] != "paid" and invoices[i - 1][1] not in taken]
        want[row] = hits[0] if hits else None
        taken |= {invoices[i - 1][1] for i in hits[:1]}
    got = billing.reconcile(transfers_of(spark, rows), spark.createDataFrame(invoices, "id long, account_id long, status string")).collect()
    assert {r.row_id: r.matched_invoice for r in got} == want and len(got) == len(want) and any(want.values())


def test_a_query_is_registered_once():
    with pytest.raises(ValueError, match="registered already"):
        catalog.query()(next(iter(catalog.QUERIES.values())).plan)


def test_defaults_of_json_objects(spark):
    rows = spark.createDataFrame([('{"k":1}',), ("{}",), ('{"a":{"b":2}}',), ('{"k":null} ',), ("[1]",), (None,)], "entitlements string")
    got = [r.entitlements for r in billing.with_default_limits(rows, {"k": 9}).collect()]
    assert got == ['{"k":1}', '{"k":9}', '{"a":{"b":2},"k":9}', '{"k":null} ', "[1]", None]


def test_term_keeps_what_is_left(spark):
    subs = spark.createDataFrame([(1, "growth", datetime(2024, 2, 1)), (2, "starter", datetime(2024, 2, 1)), (3, "growth", datetime(2023, 1, 1))], "account_id long, plan_code string, current_period_end timestamp_ntz")
    pay = spark.createDataFrame([(i, "growth") for i in (1, 2, 3, 4)], "account_id long, paid_plan string")
    got = {r.account_id: r.period_end for r in billing.term_extension(subs, pay, datetime(2024, 1, 20)).collect()}
    assert got == {1: datetime(2024, 3, 2), 2: datetime(2024, 3, 2), 3: datetime(2024, 2, 19), 4: datetime(2024, 2, 19)}


def test_stale_and_numbers(spark):
    rows = spark.createDataFrame([("100",), ("90.0",), ("x",), (None,), ("0",)], "t string")
    assert [r.s for r in rows.select(stale(F.col("t"), F.lit(700.0), 600).alias("s")).collect()] == [False, True, False, False, False]
    values = [1500000.0, 12.5, 0.1, 100.0, 123456.5, None]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(number_text(F.col("v")).alias("t")).collect()]
    assert got == [None if v is None else f"{v:g}" for v in values]


def test_set_null_and_csv(spark, tmp_path):
    kids = spark.createDataFrame([(1, 10), (2, 11)], "id long, parent long")
    got = sinks.set_null(kids, spark.createDataFrame([(10,)], "id long"), "parent").orderBy("id").collect()
    assert [r.parent for r in got] == [None, 11]
    sinks.write_csv(kids, f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").columns == ["id", "parent"]


def test_signatures(spark):
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", good), ("body", "sha256=00"), ("body", None)], "b string, h string")
    assert [r.ok for r in rows.select(signatures.webhook_signed("k", F.col("b"), F.col("h")).alias("ok")).collect()] == [True, False, False]
    assert not rows.select(signatures.webhook_signed("", F.col("b"), F.col("h")).alias("ok")).first().ok


def test_callback_and_timed_signatures(spark):
    import hashlib
    import hmac
    from urllib.parse import quote_plus

    params = {"p_b": "x y+*~é/", "p_a": "1", "p_c": ""}
    data = "&".join(f"{k}={quote_plus(params[k])}" for k in sorted(params))
    good = hmac.new(b"key", data.encode(), hashlib.sha512).hexdigest()
    rows = spark.createDataFrame([(params, good), (params, good.upper()), (params, good[:-1] + "x"), (params, None), ({}, good)], "p map<string,string>, s string")
    assert rows.select(signatures.sorted_query(F.col("p")).alias("q")).first().q == data
    assert [r.ok for r in rows.select(signatures.callback_signed("key", F.col("p"), F.col("s")).alias("ok")).collect()] == [True, True, False, False, False]
    assert not rows.select(signatures.callback_signed("", F.col("p"), F.col("s")).alias("ok")).first().ok
    v1 = hmac.new(b"key", b"17.body", hashlib.sha256).hexdigest()
    headers = [f"t=17,v1={v1}", f"v1={v1},t=17", f"t=18,v1={v1}", "t=17", "", None, f"v0=z,t=17,v1={v1},x=1"]
    timed = spark.createDataFrame([("body", h) for h in headers], "b string, h string")
    assert [r.ok for r in timed.select(signatures.timed_signed("key", F.col("b"), F.col("h")).alias("ok")).collect()] == [True, True, False, False, False, False, True]


def test_reconcile_codes(spark):
    invoices = spark.createDataFrame([(10**9, 1, "pending"), (2**32 + 5, 2, "submitted"), (7, 3, "paid")], "id long, account_id long, status string")
    memos = ["pay QR-3b9aca00 thanks", "INV 0000.0005", "QR00000007", None, "QR3B9ACA0", "x INV3B9ACA00QR00000005"]
    transfers = transfers_of(spark, [(i, i, 5.0, m, "in") for i, m in enumerate(memos)])
    got = {r.row_id: r.matched_invoice for r in billing.reconcile(transfers, invoices).collect()}
    assert got == {0: 10**9, 1: 2**32 + 5, 2: None, 3: None, 4: None, 5: None}
    clash = invoices.union(spark.createDataFrame([(5, 1, "pending")], "id long, account_id long, status string"))
    with pytest.raises(Exception, match="share a code"):
        billing.reconcile(transfers, clash).collect()


def test_settled_invoices(spark):
    invoices = spark.createDataFrame([(1, 9, "pending"), (2, 9, "submitted"), (3, 9, "paid"), (4, 8, "pending")], "id long, account_id long, status string")
    matched = spark.createDataFrame([(70, 5.0, 1), (71, 6.0, None)], "txn_id long, amount double, matched_invoice long")
    after, payments = billing.settled(invoices, matched)
    assert {r.id: r.status for r in after.collect()} == {1: "paid", 2: "void", 3: "paid", 4: "pending"}
    assert [tuple(r) for r in payments.collect()] == [(1, 9, 70, 5.0)]


def test_pptx_text():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, text in ((1, "first"), (2, "second")):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<x {a}><a:p><a:r><a:t>{text}</a:t></a:r></a:p></x>")
    text = readers.extract("talk.pptx", buffer.getvalue())
    assert text.index("first") < text.index("second")


def test_decoded_without_a_mark():
    assert readers.decoded("hié€".encode("utf-16-le")) == "hié€" and readers.decoded("né".encode("latin-1") + b"x") == "néx"


def test_decoded():
    assert [readers.decoded(b) for b in ("é".encode(), "é".encode("utf-8-sig"), "é".encode("utf-16"), "é".encode("latin-1"), b"")] == ["é", "é", "é", "é", ""]


def test_dense_ties_take_the_least_ids(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60, 0, -1)] + [(0, None), (99, [0.0, 0.0])], "id long, embedding array<double>").repartition(4)
    got = retrieval.dense_topk(items.where("id IN (20, 99)"), items, 5, block=7).orderBy("query", "rank").collect()
    assert [(r.query, r.id) for r in got] == [(20, i) for i in range(1, 6)] + [(99, i) for i in range(1, 6)]


def test_chunks_of_a_long_paragraph(spark):
    text = "a" * 2000 + "\n\n" + "b" * 10
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x\n\ny")], "id long, content string")
    got = {r.document_id: r.c for r in ingest.chunked(rows).groupBy("document_id").agg(F.array_sort(F.collect_list("content")).alias("c")).collect()}
    assert got[1] == ["a" * 800, "b" * 10] and got[2] == got[3] == [""] and got[4] == ["x\n\ny"]
    whole = ingest.chunked(rows.where("id = 1"), lossless=True).orderBy("ordinal").collect()
    assert "".join(r.content for r in whole).replace("\n", "") == text.replace("\n", "")


def _stream(spark, df, tmp_path):
    path = f"file://{tmp_path}/in.parquet"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    batch = events.rate_limit_windows(df, 2, 6 * 3600)
    streamed = events.run_to_table(events.rate_limit_stream(_stream(spark, df, tmp_path), 2, 6 * 3600), "rates")
    last = batch.groupBy("user_id").agg(F.max("window_start").alias("window_start"))
    closed = batch.join(last, ["user_id", "window_start"], "left_anti")  # the open windows are still state
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.select(*streamed.columns).collect()))


def test_quota_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 10, datetime(2024, 1, 1, 0, i)) for i in range(5)], "account_id long, id long, tokens long, created_at timestamp_ntz")
    got = events.run_to_table(events.quota_stream(_stream(spark, df, tmp_path), 25), "quota").orderBy("id").collect()
    assert [r.tokens_before for r in got] == [0, 10, 20, 30, 40] and [r.allowed for r in got] == [True, True, True, False, False]


def test_stream_dedupe_keeps_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1))], "txn long, at timestamp_ntz")
    assert events.run_to_table(events.deduplicated(_stream(spark, df, tmp_path), "txn", "at"), "dedupe").count() == 3


def test_hashed_topk_equals_dense_topk_over_hashed_vectors(spark):
    words = ["river", "stone", "bridge", "Ärger", "lamp", "7", "x9"]
    items = spark.createDataFrame([(i, " ".join(words[(i * j) % 7] for j in range(1, 2 + i % 4))) for i in range(90)] + [(90, None), (91, " ")], "id long, text string")
    asking = items.where("id % 10 = 0")
    want = retrieval.dense_topk(retrieval.hash_vectors(asking), retrieval.hash_vectors(items), 6, digits=9).where("score > 0")
    for few in (24, 0):  # by columns, by matrix products
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(retrieval, "FEW", few)
            got = retrieval.hashed_topk(asking, items, 6, query_block=4, item_block=20)
            rows = lambda df: sorted((r.query, r["rank"], r.id, r.score) for r in df.collect())
            assert rows(got) == rows(want) and len(rows(got)) > 40


def test_vector_text_rounds_as_printf_does(spark, duck):
    values = [0.0078125, 0.0234375, -0.0078125, -1.9921875, 3.0000005, -0.0, 1e-9, 123456.78, float("nan"), float("-inf")]
    df = spark.createDataFrame([(values,)], "v array<float>")
    want = duck.execute("SELECT list_transform(?::FLOAT[], lambda x: printf('%.6f', cast(x AS double)))", [values]).fetchone()[0]
    assert df.select(text.vector_text(F.col("v"))).first()[0] == f"[{','.join(want)}]"


def test_fitted_evaluates_its_norm_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def told(v):
        seen.add(1)
        return v

    rows = spark.range(3).select(text.fitted(told(F.array(F.lit(3.0), F.lit(4.0))), 384).alias("v"))
    assert [r.v[:3] for r in rows.collect()] == [[0.6, 0.8, 0.0]] * 3 and seen.value == 3
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "sqrt(aggregate(" not in plan.split("round(")[1]


def test_fitted_keeps_all_entries_of_a_longer_vector(spark):
    long = [float(i % 7) for i in range(400)]
    rows = spark.createDataFrame([(0, long), (1, [3.0, 4.0]), (2, [0.0]), (3, None)], "id int, v array<double>").select("id", text.fitted(F.col("v"), 384).alias("v"))
    got = {r.id: r.v for r in rows.collect()}
    norm = sum(x * x for x in long) ** 0.5
    assert got[0] == pytest.approx([x / norm for x in long], abs=1e-6) and len(got[0]) == 400
    assert got[1] == [0.6, 0.8] + [0.0] * 382 and got[2] == [0.0] * 384 and got[3] is None


def test_csv_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit("a,\"b").alias("t")).repartition(5)
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').schema("id long, t string").csv(f"file://{tmp_path}/c")
    assert len(list(tmp_path.glob("c/*.csv"))) == 5 and sorted(r.id for r in back.collect()) == list(range(40))


def test_chunks_go_on_before_a_batch_ends(spark):
    texts = [(i, "\n\n".join(f"{i} {j} " + "x" * 500 for j in range(i % 5))) for i in range(40)] + [(40, None), (41, " ")]
    df = spark.createDataFrame(texts, "id long, content string").coalesce(1)
    want = [(i, n, c) for i, t in texts for n, c in enumerate(ingest._packed(t, 800, "\n\n", False))]
    for given in (1, 3_000, 10**9):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ingest, "GIVEN", given)
            assert sorted(map(tuple, ingest.chunked(df).collect())) == sorted(want)
