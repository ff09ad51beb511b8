"""Clusters make only the edges that can count in them, once."""

import pytest

import __spark_entry__ as entry
from lumentab.operators import graph
from lumentab.plans import graph_queries


@pytest.mark.parametrize("name", ["entity_clusters", "theme_clusters"])
def test_clusters_make_no_weak_edges(spark, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    whole = graph_queries.built_edges(spark, d)
    strong = graph.clustering_edges(whole)
    assert sorted(map(tuple, strong.collect())) == sorted(map(tuple, graph_queries._strong(spark, d).collect()))

    def never(*a, **k):
        raise AssertionError("edges of a weight of at most 1")

    monkeypatch.setattr(graph, "jaccard_edges", never)
    assert entry.queries()[name](spark, d).count() > 0
