import json

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import logs, tree
from quarrylight.streaming import feeds


def test_feedback_log(spark, tmp_path):
    schema = logs.FEEDBACK
    ok = (1, "e1", "s", "passed", "brief", 10, ["a.py"], [], [], False)
    bad = [(1, "e2", "s", "passed", "brief", 11, ["/abs"], [], [], False), (2, "e3", "s", "p", "b", 12, [], [], [], False), (1, "e4", "a\nb", "p", "b", 13, [], None, [], False), (1, "e5", "s", "p", "b", 14, ["a/../b"], [], [], False), (1, "e6", "s", "p", "b", 15, [], [], [], True)]
    rejected = logs.append_feedback(spark.createDataFrame([ok, *bad], schema), str(tmp_path / "log"))
    assert {r.event_id for r in rejected.collect()} == {"e2", "e3", "e4", "e5", "e6"}
    logs.append_feedback(spark.createDataFrame([(1, "e7", *ok[2:5], 20, *ok[6:])], schema), str(tmp_path / "log"))
    assert [r.event_id for r in logs.read_log(spark, str(tmp_path / "log"), schema).collect()] == ["e7", "e1"]


def test_malformed_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"trace_id": "a", "created": 1}\n{oops\n')
    assert logs.read_log(spark, str(tmp_path), logs.TRACE, strict=False).count() == 1
    with pytest.raises(Exception):
        logs.read_log(spark, str(tmp_path), logs.TRACE).collect()


def test_sidecar_version(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "revision": "r", "commits": [{"sha": "x", "files": ["a"]}, {"sha": "y", "files": []}]}))
    assert [(r.ord, r.sha) for r in logs.read_sidecar(spark, str(tmp_path / "a.json")).collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": 9, "revision": "r", "commits": []}))
    with pytest.raises(Exception):
        logs.read_sidecar(spark, str(tmp_path / "b.json")).collect()


def test_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"\x00", ".env": b"K=1", "node_modules/x.js": b"1", "dist/y.js": b"1", "docs/n.md": b"hi", "skip/me.py": b"1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: (r.role, r.status, r.text) for r in tree.scan(spark, str(tmp_path), ignore=["^skip/"]).collect()}
    assert got == {"src/a.py": ("source", "read", "x = 1\n"), "src/b.bin": ("unknown", "binary", None), "docs/n.md": ("docs", "read", "hi")}


def test_merge_stream(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 2, 5)], [("a", 1, 9)]]):
        spark.createDataFrame(rows, "path string, version int, size int").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "feed").mkdir()
    like = spark.read.parquet(str(tmp_path / "in0"))
    for i in range(3):
        [f] = (tmp_path / f"in{i}").glob("*.parquet")
        f.rename(tmp_path / "feed" / f"{i}.parquet")
        feeds.merge_stream(feeds.event_stream(spark, str(tmp_path / "feed"), like), ["path"], "version", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.path, r["size"]) for r in feeds.current_table(spark, str(tmp_path / "out")).collect()}
    # the newest incoming row wins over what is stored
    assert got == {("a", 9), ("b", 1), ("c", 5)}
    # the last batch rewrote the bucket of the one key it had
    assert len(list((tmp_path / "out" / "gen=2").glob("_bucket=*"))) == 1


def test_windows_of_many_batches(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    for i, rows in enumerate([[("2025-01-01 01:00:00", "a", 1.0), ("2025-01-02 01:00:00", "a", 2.0)], [("2025-01-01 05:00:00", "a", 4.0)], [("2025-01-09 00:00:00", "b", 1.0)]]):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        [f] = (tmp_path / f"w{i}").glob("*.parquet")
        f.rename(tmp_path / "feed" / f"{i}.parquet")
    stream = feeds.event_stream(spark, str(tmp_path / "feed"), spark.read.parquet(str(tmp_path / "feed")))
    feeds.write_changes(feeds.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(str(r.w.start)[:10], r.event_type, r.events, r.value) for r in feeds.current_rows(spark, str(tmp_path / "out"), ["w", "event_type"]).collect()}
    assert {g[1:] for g in got} == {("a", 2, 5.0), ("a", 1, 2.0), ("b", 1, 1.0)}


def test_large_files_are_not_opened(spark, tmp_path):
    (tmp_path / "big.py").write_bytes(b"x = 1\n" * 200_000)
    (tmp_path / "a.py").write_bytes(b"y = 1\n")
    got = {r.path: (r.status, r.text, r.hash is None) for r in tree.scan(spark, str(tmp_path)).collect()}
    assert got == {"big.py": ("oversized", None, True), "a.py": ("read", "y = 1\n", False)}


def test_append_says_how_it_went(spark, tmp_path):
    rows = spark.range(3)
    assert tuple(logs.try_append(rows, str(tmp_path / "log"), "trace").first()) == ("trace", "appended", 3, None)
    (tmp_path / "file").write_text("x")
    r = logs.try_append(rows, str(tmp_path / "file" / "log"), "trace").first()
    assert r.status == "failed" and r.rows == 0 and r.message


def test_report_folder_and_workspace(spark, tmp_path):
    for name, text in {"a.json": '{"id": "a", "created": 1}', "b.json": '{"id": "b", "created": 5}', "c.json": "{oops", "d.txt": '{"id": "d", "created": 9}'}.items():
        (tmp_path / name).write_text(text)
    got = [(r.id, r._broken is not None) for r in logs.read_reports(spark, str(tmp_path), "id string, created bigint", "id").collect()]
    assert got == [("b", False), ("a", False), (None, True)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "ws.json").write_text(json.dumps({"version": 1, "repos": [{"id": "x", "label": "l", "root": "/x"}, {"id": "x", "label": "m", "root": "/y"}, {"id": "z", "label": "l", "root": ""}]}))
    repos, told = logs.read_workspace(spark, str(tmp_path / "w" / "ws.json"))
    assert repos.count() == 3
    assert {(r.severity, r.code, r.value) for r in told.collect()} == {("error", "repeated_id", "x"), ("warning", "repeated_label", "l"), ("error", "no_root", "2")}
