import json
import time

import pytest
from pyspark.sql import functions as F

from triago.streaming import state, tail


@pytest.fixture
def session(spark):
    for name, value in state.STORE.items():
        spark.conf.set(name, value)
    yield spark
    for name in state.STORE:
        spark.conf.unset(name)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / name)


def drained(query, seconds=60):
    """Waits until batches with new rows have ended; with timers and lifetimes batches without any go on for ever."""
    until = time.time() + seconds
    while time.time() < until and query.isActive:
        rows = [p["numInputRows"] for p in query.recentProgress]
        if any(rows) and not rows[-1]:
            return
        time.sleep(0.5)
    if query.exception():
        raise query.exception()


def all_of(spark, folder, schema):
    """What a stream has written so far; a row for each."""
    try:
        return spark.read.schema(schema).json(str(folder)).collect()
    except Exception:
        return []


def test_an_old_content_is_taken_again_after_a_restart(session, tmp_path):
    box, out = tmp_path / "box", tmp_path / "out"

    def run(days):
        rows = session.readStream.schema("path string, sha string").json(str(box))
        query = state.once_for_a_while(rows, "sha", days).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        try:
            drained(query)
        finally:
            query.stop()
        return sorted(r.path for r in all_of(session, out, "path string, sha string"))

    days, began = 40 / 86_400, time.time()
    put(box, "1.json", [{"path": "a", "sha": "x"}, {"path": "a", "sha": "x"}, {"path": "b", "sha": "y"}, {"path": "n", "sha": None}])
    assert run(days) == ["a", "b", "n"]
    put(box, "2.json", [{"path": "c", "sha": "x"}, {"path": "d", "sha": "z"}])
    seen = run(days)
    if time.time() - began < 38:  # the content is young, whatever the machine's speed
        assert seen == ["a", "b", "d", "n"]
    time.sleep(41)
    put(box, "3.json", [{"path": "e", "sha": "x"}, {"path": "f", "sha": "x"}])
    later = run(days)
    assert set(later) - set(seen) < {"e", "f"} and len(later) == len(seen) + 1


def test_growing_files_give_whole_lines_once(spark, tmp_path):
    box, out = tmp_path / "box", tmp_path / "out"
    box.mkdir()

    def run():
        rows = tail.growing_lines(spark, f"file://{box}")
        query = rows.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.file, r.offset, r.value) for r in all_of(spark, out, "file string, offset long, value string"))

    (box / "a.jsonl").write_bytes('{"page": 1}\n{"pa'.encode())
    (box / "b.jsonl").write_bytes("é\r\n\n".encode())
    (box / "c.txt").write_text("no\n")
    assert run() == [("a.jsonl", 0, '{"page": 1}'), ("b.jsonl", 0, "é"), ("b.jsonl", 4, "")]
    with (box / "a.jsonl").open("ab") as f:
        f.write(b'ge": 2}\n{"page": 3}\nto')
    (box / "d.jsonl").write_bytes(b"x\n" * 3)
    got = run()
    assert [v for f, _, v in got if f == "a.jsonl"] == ['{"page": 1}', '{"page": 2}', '{"page": 3}'] and sum(f == "d.jsonl" for f, _, _ in got) == 3
    whole = spark.read.text(str(box / "a.jsonl")).where("value like '{%}'").count()  # a batch over the file sees the same lines
    assert whole == 3 and run() == got


def test_offsets_are_ends_of_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 3)
    monkeypatch.setattr(tail, "MOST", 5)
    (tmp_path / "a.jsonl").write_bytes(b"12\n4567890\n\n34")
    reader = tail.GrowingLines(f"file://{tmp_path}", ".jsonl")
    end = reader.latestOffset()
    assert json.loads(end["files"]) == {"a.jsonl": 12}
    parts = reader.partitions(reader.initialOffset(), end)
    assert [x[1:] for p in parts for x in reader.read(p)] == [(0, "12"), (3, "4567890"), (11, "")]
    assert reader.partitions(end, end) == [] and json.loads(tail.GrowingLines(f"file://{tmp_path}/none", ".jsonl").latestOffset()["files"]) == {}


def test_a_page_that_stays_away_becomes_an_error(session, tmp_path):
    box, out = tmp_path / "box", tmp_path / "out"
    asked = {"status": None, "reason": None, "text": None}
    done = {"status": "ok", "reason": None}
    put(box, "1.json", [{"doc_id": "a", "page": 1} | asked, {"doc_id": "a", "page": 2} | asked, {"doc_id": "a", "page": 1, "text": "one"} | done, {"doc_id": "b", "page": 7, "text": "unasked"} | done])
    rows = session.readStream.schema(state.PAGES).json(str(box))
    query = state.pages_or_errors(rows, wait_s=8).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()

    def wait_for(n):
        until = time.time() + 120
        while len(found := all_of(session, out, state.PAGES)) < n and time.time() < until and query.isActive:
            time.sleep(1)
        return sorted((r.doc_id, r.page, r.status, r.reason, r.text) for r in found)

    first = [("a", 1, "ok", None, "one"), ("b", 7, "ok", None, "unasked")]
    late = ("a", 2, "erreur", "delai", None)
    try:
        assert wait_for(3) == sorted([*first, late])
        put(box, "2.json", [{"doc_id": "a", "page": 2, "text": "too late"} | done, {"doc_id": "a", "page": 1, "text": "again"} | done, {"doc_id": "c", "page": 1, "text": "new"} | done])
        assert wait_for(4) == sorted([*first, late, ("c", 1, "ok", None, "new")])
    finally:
        query.stop()


def test_batches_see_the_same_pages(spark):
    """What the stream says of pages that all came, a query over the whole table says too."""
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, "ok"), ("a", 2, None)], "doc_id string, page int, status string")
    got = rows.groupBy("doc_id", "page").agg(F.coalesce(F.max("status"), F.lit(state.ERROR)).alias("status")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "ok"), ("a", 2, "erreur")]
