"""Rounds of connected components have a row per node: read back from small files, they must not be broadcast."""

from emberline.functions import graph


def test_component_rounds_broadcast_nothing(spark, monkeypatch):
    plans, write = [], graph.cut_lineage

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    rows = graph.components(spark.range(200).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert {(r["node"], r["component"]) for r in rows} == {(i, 0) for i in range(201)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
