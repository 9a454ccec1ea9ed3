"""Links that once were lost."""

from collections import Counter

import numpy as np

from tests.llm.common import components


def test_links_across_many_cells(spark, monkeypatch):
    """No link is lost among vectors without groups, with 600 cells and whatever their centroids."""
    import numpy as np

    from corvane.llm import vectordup

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(600, 64))
    monkeypatch.setattr(vectordup, "fit_cells", lambda sample, k: centres / np.linalg.norm(centres, axis=1, keepdims=True))
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, 0.905 * base + np.sqrt(1 - 0.905**2) * side])
    near = x @ x.T >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectordup.near_vectors(frame).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}


def test_null_ids_name_no_component(spark):
    """Ids 5, null and 9, of which 5 and null are linked; a group of null ids alone; negative ids; clashing columns."""
    from corvane.llm.vectordup import near_vectors

    rows = [(5, [1.0, 0.0]), (None, [1.0, 0.01]), (9, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (-7, [0.0, -1.0]), (-8, [0.01, -1.0]), (None, None), (None, [0.7, -0.7])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, kept string, rep int")
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame).collect()), key=str)
    assert got == sorted([(False, 5, 1, 5, True), (True, 0, 1, 5, False), (False, 9, 0, 9, True), (True, 0, 1, None, True), (True, 0, 1, None, True), (False, -7, 1, -8, False), (False, -8, 1, -8, True), (True, 0, 0, None, True), (True, 0, 0, None, True)], key=str)


def test_packing_keeps_what_can_link():
    import pyarrow as pa

    from corvane.llm.vectordup import pack_vectors

    inf, nan = float("inf"), float("nan")
    rows = [[1.0, -0.0], None, [], [0.0, 0.0], [nan, 1.0], [1.0, inf], [1.0, None], [1e200, 1e200], [1e-200, 0.0], [3.0, 4.0, 5.0]]
    for kind in (pa.float64(), pa.float32()):
        got = pack_vectors(pa.array(rows, pa.list_(kind)).slice(0)).to_pylist()
        assert [g is not None for g in got][:7] == [True] + [False] * 6 and len(got[9]) == 24
    import numpy as np

    got = pack_vectors(pa.array(rows, pa.list_(pa.float64()))).to_pylist()
    assert np.frombuffer(got[0]).tolist() == [1.0, 0.0] and np.signbit(np.frombuffer(got[0])).tolist() == [False, False]
    assert np.frombuffer(got[7]).tolist() == [1.0, 1.0] and np.frombuffer(got[8]).tolist() == [1.0, 0.0]


def test_vectors(spark):
    from corvane.llm.vectordup import near_vectors

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.normal(size=16) * 0.2]) for i in range(40)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [float(x) for x in base[0][:8]]), (206, rows[0][1]), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.array(v)) for i, v in rows if i not in (200, 201, 202, 203, 204, 205)]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    pairs = [(m, n) for m in range(len(good)) for n in range(m) if cos(good[m][1], good[n][1]) >= 0.9]
    links = Counter(x for p in pairs for x in p)
    root = components([(good[m][0], good[n][0]) for m, n in pairs if good[m][0] != good[n][0]], {i for i, _ in rows})
    want = Counter((i, links[k], root[i], root[i] == i) for k, (i, _) in enumerate(good)) + Counter((i, 0, i, True) for i in (200, 201, 202, 203, 204, 205))
    for block in (2048, 7):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, block=block).collect())
        assert got == want
    assert near_vectors(frame.limit(0)).count() == 0
