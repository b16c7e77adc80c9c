import os
from pathlib import Path

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from triago.llm import language, positions, quality
from triago.llm.positions import FILE, INDEX


@pytest.fixture
def decided(spark, tmp_path, monkeypatch):
    """A table of four files, every third row decided, and the folder of its side files."""
    made = []
    monkeypatch.setattr(positions, "shared_dir", lambda session: made.append(str(tmp_path / "shared")) or f"file://{tmp_path}/shared")
    monkeypatch.setattr(positions, "RUN", 16)
    monkeypatch.setattr(positions, "LISTED", 3)
    spark.range(200).repartition(4).write.parquet(str(tmp_path / "t"))
    rows = positions.positioned(spark.read.parquet(str(tmp_path / "t")))
    values = rows.where("id % 3 = 0 and id < 150").select(FILE, INDEX, (F.col("id") + 1).alias("value"))
    return rows, positions.lookup(values), tmp_path / "shared" / "side"


def test_rows_find_their_values(decided):
    rows, find, folder = decided
    got = {r.id: r.value for r in rows.select("id", find(F.col(FILE), F.col(INDEX)).alias("value")).collect()}
    assert got == {i: i + 1 if i % 3 == 0 and i < 150 else 0 for i in range(200)}
    assert len(list(folder.glob("*.npy"))) > 4 and len(list(folder.glob("*.list"))) > 2


@pytest.mark.parametrize("suffix", ["npy", "list"])
def test_a_lost_side_file_raises(decided, suffix):
    rows, find, folder = decided
    for file in folder.glob(f"*.{suffix}"):
        os.remove(file)
    with pytest.raises(Exception, match="No such file"):
        rows.where(find(F.col(FILE), F.col(INDEX)) > 0).collect()


def test_a_repeated_move_keeps_the_file(spark, tmp_path, monkeypatch):
    """Stores that refuse to replace a file keep the first one; the draft goes."""

    class Refusing:
        def __init__(self):
            self.fs = pyarrow.fs.LocalFileSystem()

        def move(self, draft, to):
            if Path(to).exists():
                raise OSError("exists")
            self.fs.move(draft, to)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    fs = Refusing()
    for text in ("first", "again"):
        (tmp_path / "draft").write_text(text)
        positions.moved(fs, str(tmp_path / "draft"), str(tmp_path / "kept"))
        assert not (tmp_path / "draft").exists() and (tmp_path / "kept").read_text() == "first"
    with pytest.raises(OSError):
        positions.moved(fs, str(tmp_path / "gone"), str(tmp_path / "new"))


def test_one_row_of_each_id_reaches_the_driver(spark, monkeypatch):
    """An id may stand for any number of rows; of these one is picked on the executors."""
    sent, kind = [], type(spark.range(1))
    whole = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: sent.append(out := whole(self)) or out)
    rows = [(1, f"The same number again {i % 40}", "en", "a") for i in range(600)] + [(i, f"Some other text {i} " * (i % 5 + 1), "de" if i % 2 else "en", "a") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    x, y = quality.training_rows(docs, labels, 10)
    assert len(x) == len(y) == 10 and sent.pop().num_rows == 10
    language.train(docs, 12)
    assert sent.pop().num_rows == 12 and not sent
