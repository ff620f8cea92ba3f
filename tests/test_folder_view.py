"""The view of a folder over changes, deletions, failures and compaction."""

import json
import os

from sparkloom.streaming import folder_view as V

SCHEMA = "k long, v string"


def put(folder, name, rows, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((json.dumps(r) if isinstance(r, dict) else r) + "\n" for r in rows))
    os.utime(path, (at, at))


def rows(spark, out):
    return sorted((r["k"], r["v"], r["_path"].rsplit("/", 1)[1]) for r in V.view(spark, str(out), SCHEMA).collect() if r["_broken"] is None)


def test_changes_and_deletions(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    run = lambda: V.refresh(spark, str(source), str(out), SCHEMA)
    assert run() == {"new": 0, "changed": 0, "gone": 0} and rows(spark, out) == []
    put(source, "a.json", [{"k": 1, "v": "x"}, {"k": 2, "v": None, "more": 3}, "not json"], 1000)
    put(source, "sub/b c.json", [{"k": 3, "v": "y"}], 1000)
    put(source, "other.txt", [{"k": 9, "v": "z"}], 1000)
    assert run() == {"new": 2, "changed": 0, "gone": 0}
    first = [(1, "x", "a.json"), (2, None, "a.json"), (3, "y", rows(spark, out)[2][2])]
    assert rows(spark, out) == first and [r["_broken"] for r in V.view(spark, str(out), SCHEMA).filter("_broken is not null").collect()] == ["not json"]
    assert run() == {"new": 0, "changed": 0, "gone": 0} and rows(spark, out) == first
    put(source, "a.json", [{"k": 1, "v": "X"}], 2000)
    put(source, "c.json", [{"k": 4, "v": "w"}], 2000)
    (source / "sub" / "b c.json").unlink()
    assert run() == {"new": 1, "changed": 1, "gone": 1} and rows(spark, out) == [(1, "X", "a.json"), (4, "w", "c.json")]
    put(source, "sub/b c.json", [{"k": 5, "v": "back"}], 1000)
    (source / "c.json").unlink()
    assert run() == {"new": 1, "changed": 0, "gone": 1}
    then = rows(spark, out)
    assert [r[:2] for r in then] == [(1, "X"), (5, "back")]
    V.compact(spark, str(out), SCHEMA)
    assert rows(spark, out) == then and run() == {"new": 0, "changed": 0, "gone": 0}
    (source / "a.json").unlink()
    assert run()["gone"] == 1 and [r[:2] for r in rows(spark, out)] == [(5, "back")]


def test_a_refresh_that_failed_is_run_again(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    put(source, "a.json", [{"k": 1, "v": "x"}], 1000)
    V.refresh(spark, str(source), str(out), SCHEMA)
    put(source, "a.json", [{"k": 2, "v": "y"}], 2000)
    V.refresh(spark, str(source), str(out), SCHEMA)
    manifest = out / "manifest" / "version=1"
    (manifest / "_SUCCESS").unlink()  # as if it had stopped before its last step
    assert rows(spark, out) == [(1, "x", "a.json")]
    assert V.refresh(spark, str(source), str(out), SCHEMA)["changed"] == 1 and rows(spark, out) == [(2, "y", "a.json")]


def test_many_changed_files_are_read_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "MOST_NAMED", 2)
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(5):
        put(source, f"f{i}.json", [{"k": i, "v": "x"}], 1000)
    assert V.refresh(spark, str(source), str(out), SCHEMA)["new"] == 5 and [r[0] for r in rows(spark, out)] == list(range(5))
