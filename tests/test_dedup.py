"""Duplicates by hash: what goes through the driver."""

import re

import pytest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_generators(plan):
    """Explodes below a broadcast."""
    found, above = [], []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [d for d in above if d < depth]
        if re.search("^[ :+*-]*BroadcastExchange", line):
            above.append(depth)
        elif above and re.search("Generate explode", line):
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["join15_hamming", "join15_hamming_links", "ker34_duplicates", "ker34_near_with_copies"])
def test_keys_of_hashes_are_not_broadcast(spark, monkeypatch, name):
    """Spark takes keys to be as few as the hashes they are made from; no plan sends them through the driver."""
    import __spark_entry__
    from corvane.runtime import Workspace

    plans, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, *a, **b: plans.append(plan_of(df)) or write(self, df, *a, **b))
    plans.append(plan_of(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")))
    assert any("Generate explode" in p for p in plans)
    assert [x for p in plans for x in broadcast_generators(p)] == []


def test_groups_make_their_pairs_once(spark, monkeypatch):
    """Edges go both ways, but the keys of hashes meet in one join."""
    import __spark_entry__
    from corvane.runtime import Workspace

    plans, write = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, **b: plans.setdefault(name, plan_of(df)) and write(self, df, name, **b))
    __spark_entry__.queries()["ker34_near_with_copies"](spark, "/root/testdata/sf0.001")
    assert len(re.findall(r"SortMergeJoin \[part", plans["edges"])) == 1
