"""Files arriving in a folder are validated and merged, and a repeated batch changes nothing."""

from waterloom.streaming import intake


def test_intake(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(name, *lines):
        (source / name).write_text("id,elevation\n" + "\n".join(lines) + "\n")
        q = intake.start_intake(spark, str(source), "id string, elevation string", root,
                                str(tmp_path / "state"), once=True)
        q.awaitTermination(60)

    arrive("a.csv", "J1,100", "J2,x")
    arrive("b.csv", "J1,200", "J3,5")
    rows = {(r["id"], r["elevation"]) for r in intake.load_elements(spark, root).collect()}
    assert rows == {("J1", "100"), ("J2", "x"), ("J3", "5")}
    found = spark.read.parquet(f"{root}/v=0/findings").collect()
    assert [(r["check"], r["value"]) for r in found] == [("type_mismatch", "x")]
    # a version holds what its batch adds, and the stored row stays the first
    assert intake.complete_runs(spark, root) == [(0, 0), (1, 1)]
    before = {r["id"] for r in intake.load_elements(spark, root, before=1).collect()}
    assert {r["id"] for r in intake.load_elements(spark, root).collect()} - before == {"J3"}
    assert [r["status"] for r in spark.read.parquet(f"{root}/v=1/incoming").orderBy("id").collect()
            ] == ["conflict", "new"]
    arrive("c.csv", "J1,100", "J4,7")
    again = {r["id"]: r["status"] for r in spark.read.parquet(f"{root}/v=2/incoming").collect()}
    assert again == {"J1": "identical", "J4": "new"}
    assert intake.load_elements(spark, root).select("row_no").distinct().count() == 4


def test_references_meet_stored_rows(spark, tmp_path):
    def batch(version, *rows):
        df = spark.createDataFrame(rows, "id string, node1 string, _source string, n long")
        df = df.selectExpr("id", "node1", "_source", f"struct({version} AS version, n) AS row_no")
        intake.merge_batch(df, version, str(tmp_path / "t"))

    batch(0, ("J1", None, "a", 0))
    batch(1, ("P1", "J1", "b", 0), ("P2", "J9", "b", 1))
    found = spark.read.parquet(str(tmp_path / "t" / "v=1" / "findings"))
    assert [(r["check"], r["value"]) for r in found.where("check = 'missing_ref'").collect()] == [
        ("missing_ref", "J9")]


def batch_of(spark, version, rows, columns="id string, elevation string"):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], f"{columns}, n long")
    return df.selectExpr(*[c.split()[0] for c in columns.split(",")], "'s' AS _source",
                         f"struct(CAST({version} AS int) AS version, n) AS row_no")


def test_runs_of_a_thousand_batches():
    runs, most, rewritten = set(), 0, 0
    for v in range(1000):
        runs.add((v, v))
        for first, last in intake.due_merges(v):
            rewritten += last - first + 1
            runs = {r for r in runs if not (first <= r[0] and r[1] <= last)} | {(first, last)}
        live = intake.live_runs(sorted(runs))
        assert [r[0] for r in live] == [0, *[r[1] + 1 for r in live[:-1]]] and live[-1][1] == v
        most = max(most, len(live))
    assert most <= 27 and rewritten <= 3 * 1000
    # an unfinished or superseded run never hides or doubles a version
    assert intake.live_runs([(0, 0), (1, 1), (0, 9), (10, 10), (5, 5)]) == [(0, 9), (10, 10)]


def test_batches_give_what_one_batch_gives_and_plans_stay_small(spark, tmp_path):
    root, plans, fanout = str(tmp_path / "t"), [], 3
    arrivals = [[(f"J{(7 * v + i) % 20}", str(v % 3)) for i in range(3)] for v in range(10)]
    for v, rows in enumerate(arrivals):
        if v == 4:
            rows = arrivals[4] = []
        intake.merge_batch(batch_of(spark, v, rows), v, root, fanout=fanout)
        df = intake.load_elements(spark, root)
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert len(set(plans)) == 1
    assert intake.live_runs(intake.complete_runs(spark, root)) == [(0, 8), (9, 9)]
    first = {}
    for rows in arrivals:
        for i, e in rows:
            first.setdefault(i, e)
    got = sorted((r.id, r.elevation) for r in intake.load_elements(spark, root).collect())
    assert got == sorted(first.items())
    # a batch that runs again, though it was merged into a longer run, decides as before
    was = {r.row_no.n: r.status for r in spark.read.parquet(f"{root}/v=8/incoming").collect()}
    intake.merge_batch(batch_of(spark, 8, arrivals[8]), 8, root, fanout=fanout)
    assert {r.row_no.n: r.status for r in spark.read.parquet(f"{root}/v=8/incoming").collect()} == was
    assert sorted((r.id, r.elevation) for r in intake.load_elements(spark, root).collect()) == got
    # only the buckets of a batch's identifiers are read
    one = intake.load_elements(spark, root, buckets=[spark.range(1).select(
        intake.bucket(intake.F.lit("J5")).alias("b")).first().b])
    assert "J5" in {r.id for r in one.collect()} and one.count() < len(got)
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_later_columns_and_duplicates_of_stored_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    wide = "id string, elevation string, note string"
    intake.merge_batch(batch_of(spark, 0, [("J1", "5", "x"), (None, "1", None)], wide), 0, root)
    intake.merge_batch(batch_of(spark, 1, [("J1", "5"), ("J2", "6"), (None, "1"), ("", "2")]), 1, root)
    rows = intake.load_elements(spark, root)
    assert sorted(map(str, ((r.id, r.elevation, r.note) for r in rows.collect()))) == sorted(map(str, [
        ("J1", "5", "x"), (None, "1", None), ("J1", "5", None), ("J2", "6", None), (None, "1", None),
        ("", "2", None)]))
    found = spark.read.parquet(f"{root}/v=1/findings").where("check = 'duplicate_id'").collect()
    assert [(r.field, r.value) for r in found] == [("id", "J1")]
    intake.merge_batch(batch_of(spark, 2, [("J2", "6", "new")], wide), 2, root)
    assert spark.read.parquet(f"{root}/v=2/incoming").first().status == "conflict"
