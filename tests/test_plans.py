"""Physical plans are those one would want."""

import pytest

from rankloom.plans import catalog

Q = catalog.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_hits_limit_groups_before_the_shuffle(spark, sf_dir):
    p = plan(Q["w01_best_hit"](spark, sf_dir))
    assert "WindowGroupLimit" in p and "l_discount" not in p  # columns that aren't asked for aren't read


def test_top_count_sorts_no_more_than_it_returns(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(Q["o06_top_count"](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(event_type)" in plan(Q["p03_feature_filter"](spark, sf_dir))


@pytest.mark.parametrize("name", ["w01_best_hit", "a01_cluster_minimum", "a09_covariance", "a14_prefix_subsets", "a17_coverage", "a18_peak", "j01_members_and_hits", "j03_row_annotation", "j04_homologs", "j08_specific_terms", "j10_interval_overlap", "j11_best_and_second", "a37_wide_results", "f02_region_window", "p15_rescued_state"])
def test_no_products_and_no_python(name, spark, sf_dir):
    p = plan(Q[name](spark, sf_dir))
    assert not any(x in p for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"))


def test_labelled_clusters_are_found_without_ranking_hits(spark, sf_dir, monkeypatch):
    from rankloom.plans import text_queries

    want = {r[0] for r in text_queries.opt(spark, sf_dir).select("cluster").distinct().collect()}
    monkeypatch.setattr(text_queries, "opt", None)
    got = [r["row_id"] for r in text_queries.w09_unique_labels(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want
