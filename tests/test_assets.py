"""Files meet sessions below their roots only."""

from __future__ import annotations

from chronolock.operators import registry as rg


def test_what_all_files_lie_below_is_no_key(spark):
    files = spark.createDataFrame([(f"/d/{k}/a/x.harp/{n}", k) for k in range(20) for n in ("p.pkl", "other")] + [("/p.pkl", 3)], "path string, mtime int")
    got = rg._entries(files, [r"p\.pkl", r".*\.harp"], [3])
    assert {r.folder for r in got.collect()} == {f"/d/{k}" for k in range(20)}
    assert got.count() == 40 and got.where("name = 'other'").count() == 0


def test_roots_of_any_depth_find_their_files(spark):
    files = spark.createDataFrame([("/d/1/x.harp/p.pkl", 1), ("/d/2/p.pkl", 2), ("/d/2/y.harp/q", 7), ("/d/2/x.harp/q", 2), ("/d/2/y.harp/p.pkl", 1), ("p.pkl", 9)], "path string, mtime int")
    sessions = spark.createDataFrame([(1, "/d"), (2, "/d/2/"), (2, "/d/2"), (3, "/"), (4, None), (5, "p.pkl")], "session_id int, dir string")
    got = rg.resolved_assets(sessions, files, {"harp": [("dir", r".*\.harp")], "p": [("dir", r"p\.pkl")], "in": [("dir", r"p\.pkl")]}, {"in": "harp"})
    want = {1: ("/d/2/y.harp", 0, "/d/2/p.pkl", 0, "/d/2/y.harp/p.pkl", 0), 2: ("/d/2/y.harp", 0, "/d/2/p.pkl", 0, "/d/2/y.harp/p.pkl", 0), 4: (None,) * 6, 5: (None, None, "p.pkl", 0, None, None)}
    want[3] = want[1]
    assert sorted(((r[0], *r[2:]) for r in got.collect()), key=str) == sorted(((k, *want[k]) for k in (1, 2, 2, 3, 4, 5)), key=str)
