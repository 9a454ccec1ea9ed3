"""Commits over several tables: all or nothing, and again when another was first."""

import pytest
from pyspark.sql import functions as F

from corvane.operators.store import Conflict, TableGroup

KEYS = {"files": ["file_id"], "links": ["file_id", "album_id"], "other": ["x"]}


@pytest.fixture
def group(spark, tmp_path):
    g = TableGroup(spark, str(tmp_path / "g"), KEYS)
    g.commit({"files": spark.createDataFrame([(i, "new") for i in range(4)], "file_id long, status string"), "links": spark.createDataFrame([], "file_id long, album_id long"), "other": spark.range(2).withColumnRenamed("id", "x")})
    return g


def rows(g, name):
    return sorted(map(tuple, g.read(name).collect()))


def done(read):
    return {"files": read("files").where("file_id = 1").withColumn("status", F.lit("done")), "links": read("files").where("file_id = 1").select("file_id", F.lit(7).cast("long").alias("album_id"))}


def test_a_commit_changes_all_tables(group):
    group.transaction(done)
    assert rows(group, "files") == [(0, "new"), (1, "done"), (2, "new"), (3, "new")] and rows(group, "links") == [(1, 7)] and rows(group, "other") == [(0,), (1,)]


def test_a_kill_between_two_tables_shows_nothing(spark, group, monkeypatch):
    write, written = group._write, []

    def dies(name, frame):
        if written:
            raise RuntimeError("killed")
        written.append(name)
        return write(name, frame)

    monkeypatch.setattr(group, "_write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        group.transaction(done)
    again = TableGroup(spark, group.folder, KEYS)
    assert written and rows(again, "files") == [(i, "new") for i in range(4)] and rows(again, "links") == []
    again.transaction(done)
    again.sweep(1)
    assert rows(again, "files")[1] == (1, "done") and rows(again, "links") == [(1, 7)]


def test_a_lost_race_runs_again(spark, group):
    other, turns = TableGroup(spark, group.folder, KEYS), []

    def change(read):
        now = read("files").where("file_id = 2")
        if not turns:
            other.commit({"files": now.withColumn("status", F.lit("theirs"))})
        turns.append(now.first()["status"])
        return {"files": now.withColumn("status", F.concat("status", F.lit("+mine")))}

    group.transaction(change)
    assert turns == ["new", "theirs"] and rows(group, "files")[2] == (2, "theirs+mine")

    def always(read):
        other.commit({"links": spark.createDataFrame([(9, 9)], "file_id long, album_id long")})
        return {"files": read("links").select("file_id", F.lit("x").alias("status"))}

    with pytest.raises(Conflict):
        group.transaction(always, tries=2)


def test_commits_to_other_tables_do_not_disturb(spark, group):
    other = TableGroup(spark, group.folder, KEYS)

    def change(read):
        other.commit({"other": spark.createDataFrame([(5,)], "x long")})
        return done(read)

    before = group.version()
    assert group.transaction(change) == before + 2 and rows(group, "other") == [(0,), (1,), (5,)] and rows(group, "links") == [(1, 7)]


def test_a_number_is_taken_once(group):
    state = group.state() | {"mark": "late"}
    assert not group._publish(group.version(), state) and group._publish(group.version() + 1, state) and group.state()["mark"] == "late"


def test_compacted_tables_read_the_same(spark, group):
    for turn in range(4):
        group.commit({"files": spark.createDataFrame([(turn, f"t{turn}"), (10 + turn, "added")], "file_id long, status string")})
    before = rows(group, "files")
    group.compact(2)
    assert rows(group, "files") == before and group.state()["tables"]["files"]["parts"] == []


def test_file_index_over_stored_indexes(spark, tmp_path):
    """Hybrid, related, names and nearest of an index, against what its rows say."""
    from corvane.index import FileIndex
    from corvane.schema import EMBEDDINGS, FILES

    index = FileIndex(spark, str(tmp_path / "index"), now_ms=lambda: 5)
    texts = ["tax invoice of march", "holiday photo beach", "invoice for the boat", "boat trip notes", "tax tax tax"]
    files = [{"file_id": i, "uri": f"content://a/{i % 2}/{i}", "display_name": f"{'Tax' if i == 4 else 'note'}_{i}.txt", "extracted_text": t, "is_deleted": i == 3, "processing_status": "CONTENT_DONE"} for i, t in enumerate(texts)]
    vectors = [[1.0, 0.0], [0.0, 1.0], [0.8, 0.6], [0.6, 0.8], [1.0, 0.0]]
    index._merge(files=spark.createDataFrame([tuple(f.get(c) for c in FILES.names) for f in files], FILES), embeddings=spark.createDataFrame([(i, "m1", v, 2, 0) for i, v in enumerate(vectors)], EMBEDDINGS))
    index.build_search()
    assert [r["file_id"] for r in index.match("invoice").collect()] == [0, 2] and index.match("boat trip").count() == 0
    assert [tuple(r) for r in index.find_names("tax_").collect()] == [(4, "Tax_4.txt")]
    assert [(r["rank"], r["file_id"]) for r in index.nearest([(0, [1.0, 0.0])], 2).collect()] == [(1, 4), (2, 2)]
    s = index.settings
    best = {r["file_id"]: r["score"] for r in index.hybrid("Tax invoice", [1.0, 0.0]).collect()}
    assert set(best) == {0, 1, 2, 4}
    assert best[0] == pytest.approx(s.search_weight_keyword + s.search_weight_semantic) and best[1] == 0.0
    assert best[4] == pytest.approx(0.5 * s.search_weight_keyword + s.search_weight_semantic + 0.5 * s.search_weight_filename)
    assert set(r["file_id"] for r in index.hybrid("holiday").collect()) == {1}
    near = {r["file_id"]: r["score"] for r in index.related([0]).collect()}
    assert near == {4: pytest.approx(1.03), 2: pytest.approx(0.83)}


def test_duplicates_with_their_copies(spark, tmp_path):
    """Equal contents are one exact group; equal and near hashes of other contents are one near group, and a dismissed pair is none."""
    from corvane.index import FileIndex
    from corvane.schema import FILES

    index = FileIndex(spark, str(tmp_path / "index"), now_ms=lambda: 5)
    hashes = {0: ("x", 0b1111), 1: ("x", 0b1111), 2: ("y", 0b1111), 3: ("z", 0b1110), 4: ("u", 0x0F0F0F0F0F0F), 5: ("v", 0x0F0F0F0F0F0F), 6: ("w", None), 7: ("t", 0x7FFFFFFFFFFFFFFF)}
    rows = [{"file_id": i, "uri": f"u{i}", "display_name": f"n{i}", "sha256_hash": sha, "perceptual_hash": h, "is_deleted": False} for i, (sha, h) in hashes.items()]
    index._merge(files=spark.createDataFrame([tuple(r.get(c) for c in FILES.names) for r in rows], FILES))
    groups = {}
    for r in index.duplicates().collect():
        groups.setdefault((r["group_type"], r["representative_file_id"]), set()).add(r["file_id"])
    assert groups == {("EXACT", 0): {0, 1}, ("PERCEPTUAL_NEAR", 0): {0, 2, 3}, ("PERCEPTUAL_NEAR", 4): {4, 5}}
    index.dismiss(spark.createDataFrame([(4, 5)], "file_a long, file_b long"))
    assert index.duplicates().where("representative_file_id = 4").count() == 0
