"""Catalogue wiring, SQL parity on the smallest tables, privacy of outputs."""

import importlib
import inspect
import os
import sys
from unittest import mock

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from tools.check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
PARITY = ["s15_derive_edges", "x20_lexicon_scores", "g04_compare_raw_organic", "g20_topic_audience", "c07_behaviour_likelihood",
          "b02_topic_bursts", "l05_merkle_roots", "n04_two_hop_reach"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    d = entry_module.entry(spark)
    assert {"view", "anxiety", "n"} <= set(d.columns) and d.count() == 2


@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    d = entry_module.queries()[name](spark, SF)
    rel = con.sql(entry_module.oracle_sql()[name])
    assert rows_of(d.columns, [tuple(r) for r in d.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_no_account_carries_an_audience_cue(spark):
    cues = {"region", "age", "interest", "interests", "geography"}
    for name in ("x17_infer_region", "x18_infer_interest", "x19_infer_age_bracket", "g17_dimension_counts", "g19_cohort_demographics", "n12_account_detail"):
        columns = set(entry_module.queries()[name](spark, SF).columns)
        assert not ({"account_id", "author_id"} & columns and cues & columns)


@pytest.mark.parametrize("name, operator, want", [
    ("n02_pagerank_converged", "graph.pagerank", {"tolerance": 1e-6}), ("n03_sampled_betweenness", "graph.sampled_betweenness", {"pivots": 200}),
    ("n07_bridge_accounts", "graph.sampled_betweenness", {"pivots": 300, "directed": False}),
    ("n09_influence_views", "graph.influence_views", {"pivots": 200, "bridge_pivots": 300}),
    ("b06_gbr_forecast", "forecast.gbr_forecast", {"trees": 150}), ("b08_compute_forecasts", "forecast.compute_forecasts", {"trees": 150}),
    ("b09_backtest", "forecast.backtest", {"trees": 150}),
])
def test_queries_run_the_whole_job(monkeypatch, name, operator, want):
    from driftlens.plans import catalog

    class Called(Exception):
        pass

    module, attribute = operator.split(".")
    module = importlib.import_module(f"driftlens.operators.{module}")
    signature = inspect.signature(getattr(module, attribute))

    def called(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in want})

    catalog.load()
    monkeypatch.setattr(module, attribute, called)
    if name.startswith("n07"):
        monkeypatch.setattr(module, "communities", lambda graph: graph)
    with pytest.raises(Called) as got:
        catalog._QUERIES[name](mock.MagicMock())
    assert got.value.args[0] == want


@pytest.mark.parametrize("name, attribute", [("c06_run_coordination", "run_coordination"), ("c02_narrative_clusters_all_links", "narrative_links")])
def test_coordination_over_all_links(spark, monkeypatch, name, attribute):
    from driftlens.operators import coordination
    from driftlens.plans import catalog

    catalog.load()
    signature, seen = inspect.signature(getattr(coordination, attribute)), {}

    def called(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(coordination, attribute, called)
    views = mock.MagicMock()
    views.stage = lambda name, build: build()
    with pytest.raises(InterruptedError):
        catalog._QUERIES[name](views)
    assert set(seen["use"]) == {"text", "tag", "origin"} and seen.get("min_sim", 0.9) == 0.9 and seen["tags"] == "hashtags"
