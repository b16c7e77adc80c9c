import glob
import os

import pytest

from triago.sources import deposit

FILES = [("a.pdf", bytearray(b"one")), ("b.json", bytearray(b"{}")), ("c", None), ("d", bytearray()), ("a.pdf", bytearray(b"two"))]


def files(spark, rows):
    return spark.createDataFrame(rows, deposit.FILES).repartition(3)


def seen(spark, folder):
    return sorted((r.name, bytes(r.content)) for r in deposit.current(spark, folder).collect())


def test_versions_replace_each_other_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert seen(spark, folder) == [] and deposit.versions(spark, folder) == []
    first = deposit.deposit(files(spark, FILES), folder)
    whole = sorted((n, bytes(c or b"")) for n, c in FILES)
    assert seen(spark, folder) == whole
    held = deposit.current(spark, folder)  # a reader from before the swap goes on with its version
    second = deposit.deposit(files(spark, FILES[:1]), folder)
    assert seen(spark, folder) == [("a.pdf", b"one")] and held.count() == 5 and deposit.versions(spark, folder) == [first, second]
    assert deposit.roll_back(spark, folder) == first and seen(spark, folder) == whole
    assert deposit.roll_back(spark, folder) is None and seen(spark, folder) == []
    deposit.deposit(files(spark, []), folder)
    assert seen(spark, folder) == []


@pytest.mark.parametrize("harm", ["damaged", "missing", "more"])
def test_a_damaged_copy_is_not_published(spark, tmp_path, harm):
    folder = str(tmp_path / "out")
    before = deposit.deposit(files(spark, FILES[:2]), folder)
    version = deposit.stage(files(spark, FILES), folder)
    copies = [(n, bytearray(b"0n3")) if c == bytearray(b"one") else (n, c or bytearray()) for n, c in FILES] if harm == "damaged" else FILES[1:] if harm == "missing" else [*FILES, ("x", bytearray(b"x"))]
    files(spark, copies).write.mode("overwrite").parquet(f"{folder}/{version}/files")
    with pytest.raises(deposit.DepositError):
        deposit.publish(spark, folder, version)
    assert seen(spark, folder) == [("a.pdf", b"one"), ("b.json", b"{}")] and deposit.versions(spark, folder) == [before]
    assert deposit.unpublished(spark, folder) == [version]
    deposit.discard(spark, folder, version)
    assert deposit.unpublished(spark, folder) == []
    with pytest.raises(ValueError):
        deposit.discard(spark, folder, before)


@pytest.mark.parametrize("step", ["manifest", "differences", "_point"])
def test_a_crash_between_steps_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "out")
    deposit.deposit(files(spark, FILES[:1]), folder)

    def crash(*args):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(deposit, step, crash)
        with pytest.raises(RuntimeError, match="power cut"):
            deposit.deposit(files(spark, FILES), folder)
    assert seen(spark, folder) == [("a.pdf", b"one")] and deposit.unpublished(spark, folder) == []
    deposit.deposit(files(spark, FILES), folder)  # and the next run goes through
    assert len(seen(spark, folder)) == 5 and not [f for f in glob.glob(f"{folder}/.CURRENT.*") if not f.endswith(".crc")]


def test_a_table_that_changes_while_it_is_written_is_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    drawn = F.udf(lambda name: os.urandom(8), "binary").asNondeterministic()
    with pytest.raises(deposit.DepositError, match="missing or damaged"):
        deposit.deposit(files(spark, FILES).select("name", drawn("name").alias("content")), str(tmp_path / "out"))
    assert seen(spark, str(tmp_path / "out")) == [] and deposit.unpublished(spark, str(tmp_path / "out")) == []
