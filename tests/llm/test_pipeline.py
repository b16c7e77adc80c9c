import random

import pytest
from pyspark.sql import functions as F
from test_simhash import brute_components

import corpus_pipeline
from triago.llm import near_copies, positions, registry, simhash
from triago.llm.common import written


def test_stages_work_on_what_came_before(spark, tmp_path):
    words = {"en": "the of and to in that is was for with", "fr": "le la les des une pour dans est que qui"}
    text = lambda lang, i: " ".join(w if (i >> (j % 7)) & 1 else f"{w}{(i * 31 + j * 7) % 97:x}" for j, w in enumerate(words[lang].split() * 8))
    rows = [(i, text("en" if i % 2 else "fr", i + 3), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i][1], rows[i][2], "s0") for i in range(10)] + [(200, "123 !!", None, "s1"), (201, None, None, None)] + [(300 + i, "BUY!! ### $$$ %%% " * 30 + str(i), "en", "s1") for i in range(12)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
        docs = out
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not {200, 201} & kept[0] and set(range(80)) <= kept[0]
    assert not any(i >= 300 for i in kept[1]) and set(range(80)) <= kept[1]
    assert not any(100 <= i < 200 for i in kept[2]) and set(range(10)) <= kept[2]
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert docs.where("not decoded").count() == 0


def test_stages_leave_columns_of_any_name_alone_and_take_empty_tables(spark, tmp_path, odd_docs, no_docs):
    """Names that operators use inside, as columns of the table, come back as they were."""
    work = ("_row_file", "_row_index", "_copies", "_copy", "kept_0", "node", "at", "same", "w", "rank", "taken", "quality", "score", "lang_pred", "ids", "prefix", "members")
    rows = odd_docs.selectExpr("*", *(f"concat('{name}', doc_id) AS `{name}`" for name in work))
    for k, docs in enumerate((rows, rows.where("false"))):
        docs.write.parquet(str(tmp_path / f"d{k}"))
        docs = spark.read.parquet(str(tmp_path / f"d{k}"))
        spark.createDataFrame([(1, 1, 0), (9, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"s{k}" / "labels.parquet"))
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, docs, str(tmp_path / f"s{k}"))
            assert got.columns == docs.columns, name
            for r in got.collect():
                assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in work), name
        assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == (0 if k else 2 * docs.count() - docs.where("coalesce(text, '') = ''").count())


def test_near_duplicates_are_components_of_fingerprints_and_of_similar_texts(spark, tmp_path):
    """Fingerprints count repeats and link texts whose sets of shingles are far apart; edited blocks are the other way round.
    Groups run through links of both kinds."""
    rng, texts = random.Random(21), {}
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    for i in range(12):
        a, tails = words(300), [words(30), words(30)]
        b = a[:100] + words(20) + a[120:]
        c = words(11) * 100
        members = [a, b, c + tails[0], c + tails[1], b + (b[:50] + words(8)) * 2]
        texts |= {100 * i + k: " ".join(x) for k, x in enumerate(rng.sample(members, len(members)))}
    fps = {i: simhash.fingerprint(simhash.split_words(t)) for i, t in texts.items()}
    sets = {i: set(near_copies._distinct(t, 5).tolist()) for i, t in texts.items()}
    both = [(i, j) for i in texts for j in texts if i < j]
    near = {(i, j) for i, j in both if bin(fps[i] ^ fps[j]).count("1") <= 3}
    similar = {(i, j) for i, j in both if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(near - similar) > 5 and len(similar - near) > 5
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(near | similar, texts).values()))


def test_run_on_an_empty_table(spark, tmp_path, no_docs):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_runs_of_rows_have_side_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "RUN", 16)
    spark.range(500).repartition(2).write.parquet(str(tmp_path / "t"))
    rows = positions.positioned(spark.read.parquet(str(tmp_path / "t")))
    chosen = written(rows.where("id % 5 = 0").select(positions.FILE, positions.INDEX, (F.col("id") + 1).alias("value")))
    found = rows.withColumn("got", positions.lookup(chosen)(F.col(positions.FILE), F.col(positions.INDEX)))
    assert sorted((r.id, r.got) for r in found.collect()) == [(i, i + 1 if i % 5 == 0 else 0) for i in range(500)]


def test_decisions_meet_their_rows(spark, tmp_path):
    spark.range(1000).repartition(3).selectExpr("id", "'x' AS value", "1 AS _metadata").write.parquet(str(tmp_path / "t"))
    rows = positions.positioned(spark.read.parquet(str(tmp_path / "t")))
    chosen = written(rows.where("id % 7 = 0").select(positions.FILE, positions.INDEX, (F.col("id") + 1).alias("v")))
    found = rows.withColumn("got", positions.lookup(chosen, "v")(F.col(positions.FILE), F.col(positions.INDEX)))
    assert sorted((r.id, r.got) for r in found.collect()) == [(i, i + 1 if i % 7 == 0 else 0) for i in range(1000)]
    none = rows.withColumn("got", positions.lookup(chosen.where("false"), "v")(F.col(positions.FILE), F.col(positions.INDEX)))
    assert none.where("got <> 0").count() == 0


def test_rows_made_in_the_plan_have_positions_of_their_own(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    twice = read.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, n in ((twice, 20), (read.unionByName(read), 20), (read.where("id > 3"), 6), (read, 10), (spark.range(5), 5)):
        rows = positions.positioned(df)
        assert rows.count() == rows.select(positions.FILE, positions.INDEX).distinct().count() == n
    kept = positions.positioned(read.where("id > 3")).select(positions.FILE).first()[0]
    assert str(tmp_path) in kept  # straight from the file, nothing written


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_its_query(n):
    assert any(name.startswith(f"op{n}_") for name in registry.queries()) and "pipeline" in registry.queries()
