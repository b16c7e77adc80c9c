import random

import pytest
from pyspark.sql import functions as F

from triago.operators import filing
from triago.operators.prefix import running


def plain_names(rows, taken=()):
    """Names one after another: the base, or the first number that is neither given, taken, nor another base as it stands."""
    low = lambda x: x.lower()
    used = {(f, low(n)) for f, n in taken}
    wanted = {(f, low(b)) for _, f, b in rows} | used
    out, given = {}, set()
    for source, folder, base in sorted(rows):
        name, n = base, 0
        while (folder, low(name)) in (given | used if n == 0 else given | wanted):
            n += 1
            name = f"{base}_{n}"
        given.add((folder, low(name)))
        out[source] = name
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "A", "a_1", "a_2", "A_3", "a_1_1", "b", "b_7", "x_0", "x", "x_01", "c_5", "C"]
    rows = [(f"s{i:04}", rng.choice(["F", "G"]), rng.choice(bases)) for i in range(120)]
    taken = [("F", "a"), ("F", "b_1"), ("G", "X"), ("G", "x_2"), ("F", "other")] if seed % 2 else []
    docs = spark.createDataFrame(rows, "source string, folder string, base string").selectExpr("*", "'n' AS name", "1 AS used", "'l' AS low", "2 AS place", "3 AS row", "4 AS _low", "5 AS blocked").repartition(3)
    got = filing.without_collisions(docs, spark.createDataFrame(taken, "folder string, name string") if taken else None)
    assert got.columns == [*(c for c in docs.columns if c != "name"), "name"]
    assert {r.source: r.name for r in got.collect()} == plain_names(rows, taken)
    assert {tuple(r)[3:8] for r in got.drop("name").collect()} == {(1, "l", 2, 3, 4)}


def test_one_base_for_all(spark):
    rows = [(f"s{i:05}", "F", "doc") for i in range(2000)] + [(f"t{i}", "F", f"doc_{i * 3 + 1}") for i in range(700)]
    got = {r.source: r.name for r in filing.without_collisions(spark.createDataFrame(rows, "source string, folder string, base string")).collect()}
    free = [i for i in range(1, 5000) if (i - 1) % 3 or i > 3 * 699 + 1]
    assert got["s00000"] == "doc" and [got[f"s{i:05}"] for i in range(1, 2000)] == [f"doc_{n}" for n in free[:1999]]
    assert all(got[f"t{i}"] == f"doc_{i * 3 + 1}" for i in range(700))


def test_one_order_for_all(spark):
    rows = [("same", "F", "doc")] * 500 + [(None, "F", "doc"), (None, None, "doc"), ("x", None, None)]
    got = filing.without_collisions(spark.createDataFrame(rows, "source string, folder string, base string")).collect()
    assert sorted(r.name for r in got if r.folder) == sorted(["doc", *(f"doc_{i}" for i in range(1, 501))])
    assert sorted(str(r.name) for r in got if not r.folder) == ["None", "doc"]
    empty = spark.createDataFrame([], "source string, folder string, base string")
    assert filing.without_collisions(empty).count() == 0


def test_running_sums_have_no_window_over_a_group(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'rare' || id % 50 ELSE 'hot' END AS g", "id % 7 AS v", "'x' AS part", "'y' AS `row`", "'z' AS at").repartition(6)
    from pyspark.sql import functions as F

    got = running(rows, ["g"], ["v", "id"], "sum", F.col("v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line or line.strip().startswith("Window")]
    assert windows and all("part#" in line for line in windows)
    wanted, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.v, r.id)):
        sums[r.g] = sums.get(r.g, 0) + r.v
        wanted[r.id] = sums[r.g]
    assert {r.id: r["sum"] for r in got.collect()} == wanted
    assert got.columns == [*rows.columns, "sum"]


def test_duplicates_and_known_contents(spark):
    files = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", None, 3), ("d", None, 4), (None, "y", 5)], "path string, sha string, _sha int").selectExpr("*", "'k' AS _first", "0 AS duplicate", "'f' AS file", "'c' AS content")
    got = filing.with_duplicates(files)
    assert {(r.path, r._sha): r.duplicate for r in got.collect()} == {("b", 1): True, ("a", 2): False, ("c", 3): False, ("d", 4): True, (None, 5): False}
    assert sorted(got.columns) == sorted(files.columns)
    done = spark.createDataFrame([("x",), (None,), ("x",)], "sha string")
    assert [r._sha for r in filing.unprocessed(files, done).collect()] == [5]
    assert filing.unprocessed(files, done).columns == files.columns
    assert filing.unprocessed(files, done.limit(0)).count() == 5 and filing.unprocessed(files.limit(0), done).count() == 0


def test_runs_of_workers_equal_a_plain_walk(spark):
    from triago.sources.ocr import worker_runs

    rng = random.Random(3)
    rows = [(rng.choice(("r1", "r1", None)), rng.choice(("a", "b", None)), rng.choice((None, 10, 50)), i) for i in range(200)]
    wanted, last, place = [], {}, {}
    for run, worker, memory, _ in rows:
        place[run] = place.get(run, 0) + 1
        if run not in last or last[run][1] != worker:
            last[run] = [run, worker, place[run], 0, None]
            wanted.append(last[run])
        last[run][3] += 1
        last[run][4] = max((m for m in (last[run][4], memory) if m is not None), default=None)
    pages = spark.createDataFrame(rows, "run string, worker string, memory_mb int, at int").selectExpr("*", "'x' AS place", "'y' AS own", "1 AS memory").repartition(4)
    got = worker_runs(pages, ["at"])
    assert sorted(map(str, ([r.run, r.worker, r.start, r.pages, r.peak_mb] for r in got.collect()))) == sorted(map(str, wanted))
    assert worker_runs(pages.limit(0), ["at"]).count() == 0


def test_names_are_given_to_documents_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def base(source):
        seen.add(1)
        return "a"

    docs = spark.range(20).select(F.col("id").cast("string").alias("source"), F.lit("F").alias("folder"), base(F.col("id").cast("string")).alias("base"))
    assert filing.without_collisions(docs).select("name").distinct().count() == 20
    assert seen.value == 20
