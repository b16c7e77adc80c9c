import hashlib
import tarfile
import zlib
from pathlib import Path

import pytest

from triago.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 100_000])
def test_png_round_trip(n):
    payload = media.padded(bytes(i % 251 for i in range(n)))
    assert len(payload) % media.UNIT == 0 and len(payload) >= media.UNIT
    image = media.png_encode(payload)
    assert media.png_decode(image) == payload and media.png_header(image[: media.HEADER_BYTES]) == (576, len(payload) // 576, 8)
    with pytest.raises(ValueError):
        media.png_header(b"x" + image[1:33])


def test_shards_are_tar_files(spark, odd_docs, tmp_path):
    listed = media.store(odd_docs.coalesce(1), f"file://{tmp_path}", "doc_id", "text").collect()
    assert len(listed) == 10
    members = {}
    for path in Path(tmp_path).glob("*.tar"):
        with tarfile.open(path) as tar:
            for m in tar:
                members[path.name, m.offset_data] = (m.name, tar.extractfile(m).read())
    for r in listed:
        name, data = members[r.shard, r.offset]
        assert name == f"{r.media_sha256}.png" and hashlib.sha256(data).hexdigest() == r.media_sha256 and len(data) == r.length
    assert len(members) < 10  # copies are stored once


def test_copies_are_stored_once_over_all_files(spark, tmp_path):
    texts = [f"text {i % 40}" for i in range(400)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    (tmp_path / "tar").mkdir()
    listed = media.store(rows, f"file://{tmp_path}/tar", "doc_id", "text").collect()
    assert len(listed) == 402 and len({(r.shard, r.offset) for r in listed}) == len({r.media_sha256 for r in listed}) == 41
    members = [m.name for path in (tmp_path / "tar").glob("*.tar") for m in tarfile.open(path)]
    assert len(members) == len(set(members)) == 41


def test_media_query(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = media.op10_media_shards(spark, str(tmp_path / "a")).collect()
    wanted = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        wanted.append((r.doc_id or 0, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(wanted)
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in got if r.n_bytes == 0}) == 1
    no_docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert media.op10_media_shards(spark, str(tmp_path / "b")).count() == 0
