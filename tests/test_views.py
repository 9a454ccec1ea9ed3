"""Live views against the query from nothing, after every change."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import albums as al
from corvane.operators.store import ChangeTable
from corvane.streaming import views as vw

FILES = "file_id long, processing_status string, is_deleted boolean, name string"


def counts(view):
    return sorted((r["processing_status"] or "", r["total"]) for r in view.read().collect())


def plain(table):
    rows = table.read().where("not is_deleted").groupBy("processing_status").count().collect()
    return sorted((r["processing_status"] or "", r["count"]) for r in rows)


def test_counts_after_every_version(spark, tmp_path):
    rng, states = random.Random(9), ["DISCOVERED", "INDEXED", "FAILED", None]
    row = lambda i: (i, rng.choice(states), rng.random() < 0.2, f"n{rng.randrange(9)}")
    table = ChangeTable(spark, str(tmp_path / "files"), ["file_id"])
    table.write(spark.createDataFrame([row(i) for i in range(60)], FILES))
    view = vw.live_statuses(spark, table, str(tmp_path / "view"), table.read().schema)
    view.refresh().awaitTermination()
    assert counts(view) == plain(table)
    for turn in range(2):
        ids = rng.sample(range(90), 25)
        table.merge(spark.createDataFrame([row(i) for i in ids], FILES))
        view = vw.live_statuses(spark, table, str(tmp_path / "view"), table.read().schema)
        view.refresh().awaitTermination()
        assert counts(view) == plain(table)
        written = spark.read.parquet(str(tmp_path / "view/sums" / f"v={view.sums.version()}"))
        assert written.count() <= 8
    table.merge(spark.createDataFrame([(i, "INDEXED", True, "x") for i in range(90)], FILES))
    view.refresh().awaitTermination()
    assert counts(view) == plain(table) == []


def test_a_batch_is_applied_once(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "files"), ["file_id"])
    table.write(spark.createDataFrame([(i, "A", False, "") for i in range(10)], FILES))
    view = vw.live_statuses(spark, table, str(tmp_path / "view"), table.read().schema)
    apply = view._apply

    died = []

    def dies_after(changes, batch):
        apply(changes, batch)
        died.append(batch)
        raise RuntimeError("killed")

    view._apply = dies_after
    with pytest.raises(Exception):
        view.refresh().awaitTermination()
    assert died == [0] and view.sums.version() == 2
    view._apply = apply
    table.merge(spark.createDataFrame([(3, "B", False, ""), (12, "B", False, "")], FILES))
    view.refresh().awaitTermination()
    assert counts(view) == [("A", 9), ("B", 2)]


def test_album_tree_from_the_view(spark, tmp_path):
    albums = spark.createDataFrame([(1, "Finance", None), (2, "Tax", 1), (3, "Empty", 1)], "album_id long, name string, parent_album_id long")
    links = ChangeTable(spark, str(tmp_path / "links"), ["file_id", "album_id"])
    schema = "file_id long, album_id long, confidence double"
    links.write(spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (2, 2, 0.5)], schema))
    view = vw.live_album_files(spark, links, str(tmp_path / "view"), links.read().schema)
    view.refresh().awaitTermination()
    links.merge(spark.createDataFrame([(2, 2, 0.9), (5, 2, 0.1)], schema))
    view.refresh().awaitTermination()
    told = vw.album_counts(albums, view)
    assert {r["album_id"]: r["file_count"] for r in told.collect()} == {1: 2, 2: 2, 3: 0}
    assert al.tree(albums, told.select("album_id", F.col("file_count"))).count() == 3
