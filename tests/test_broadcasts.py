"""Joins of facts with flow graphs are never broadcast by the few bytes of a written table."""

from tessaline import storage
from tessaline.operators import dataflow


def test_facts_edges_and_uses_meet_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(dataflow, "FEW_FACTS", 0, raising=False)
    plans, save = [], storage.save
    monkeypatch.setattr(storage, "save", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or save(df, label))
    n = spark.range(400)
    edges = n.selectExpr("id AS src", "id + 1 AS dst").where("dst % 8 <> 0")
    sources = n.where("id % 8 = 0").selectExpr("id AS node", "'x' AS var", "id AS origin")
    assigns = n.where("id % 8 = 3").selectExpr("id AS node", "'y' AS target", "'x' AS value")
    kills = n.where("id % 8 = 5").selectExpr("id AS node", "'x' AS var")
    cleaners = n.where("id % 16 = 4").selectExpr("id AS node", "'y' AS var", "'sql' AS sink")
    guards = n.where("id % 8 = 6").selectExpr("id AS src", "id + 1 AS dst", "'x' AS var")
    ends, begins = dataflow.taint_paths(edges, sources, assigns, kills, ["shell", "sql"], cleaners, guards)
    found = dataflow.path_findings(begins, n.selectExpr("id AS node", "'sql' AS sink", "'y' AS var"), ["shell", "sql"])
    plans.append(("findings", found._jdf.queryExecution().executedPlan().toString()))
    assert not [label for label, plan in plans if "BroadcastHashJoin" in plan]
    assert sorted(r.node % 8 for r in ends.where("var = 'y'").collect()) == sorted([3, 4, 5, 6, 7] * 50) and found.count() == 4 * 50 - 3 * 25
