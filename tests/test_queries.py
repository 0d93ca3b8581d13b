"""Every query of the library against its DuckDB twin, over the whole smallest tables."""

import pytest
from compare import same
from conftest import SF

from tradewind.plans import business, content, state  # noqa: F401
from tradewind.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


#: What a match, a search or a gate must find at least once, so that equal emptiness is no success.
HITS = {"reconcile_transfers": "matched_invoice IS NOT NULL AND matched_invoice <> named_invoice", "reconcile_webhooks": "matched_invoice IS NOT NULL", "settle_invoices": "status = 'void'", "settle_payments": "true", "lexical_topk": "score < 1", "hybrid_rrf": "kw", "product_search": "true", "quota_running": "NOT allowed", "handoff_policy": "needs_human", "job_log": "status = 'ready' AND attempts > 1", "intake_settlement": "matched_invoice IS NOT NULL", "embedding_index": "run = 2", "channel_by_key": "true", "chunk_hybrid": "kw", "signed_callbacks": "timed AND redirected", "quota_stream": "NOT allowed", "set_null": "bot_id IS NULL", "rate_limit_state": "hits > allowed"}


@pytest.mark.parametrize("name", sorted(HITS))
def test_hits(spark, name):
    assert not QUERIES[name](spark, SF).where(HITS[name]).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
