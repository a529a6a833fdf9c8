from limpid.operators import steps
from limpid.operators.sampling import sample_values
from limpid.sources import runlog


def test_the_last_events_of_several_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(6):
        runlog.append_log(spark.createDataFrame([(f"s{i}",)], "stage string"), path)
    assert [r["stage"] for r in runlog.read_log(spark, path, limit=3).collect()] == ["s3", "s4", "s5"]
    found = runlog.read_log(spark, path, position=True).orderBy("_pos").collect()
    assert [r["stage"] for r in found] == [f"s{i}" for i in range(6)] and "fields" in found[0].asDict()


def test_starts_and_ends_of_stages(spark):
    rows = [("r1", 1, "stage_start", "a", None, None), ("r1", 2, "stage_end", "a", "ok", 5), ("r1", 3, "stage_start", "b", None, None),
            ("r1", 4, "stage_start", "b", None, None), ("r1", 5, "stage_end", "b", "failed", 7), ("r1", 6, "stage_start", "c", None, None),
            ("r2", 1, "stage_end", "a", "ok", 9), ("r2", 2, "stage_start", "a", None, None), ("r2", 3, "note", "a", None, None),
            (None, 1, "stage_start", "a", None, None), (None, 2, "stage_start", "b", None, None), (None, 3, "stage_end", "b", "ok", None)]
    log = spark.createDataFrame(rows, "id string, at int, type string, stage string, status string, duration_ms long")
    got = sorted((tuple(r) for r in steps.stage_spans(log, "at", "id").collect()), key=repr)
    assert got == sorted([("r1", "a", "ok", 5), ("r1", "b", "crashed", None), ("r1", "b", "failed", 7), ("r1", "c", "open", None),
                          ("r2", "a", "ok", 9), ("r2", "a", "open", None), (None, "a", "crashed", None), (None, "b", "ok", None)], key=repr)
    summed = {r["stage"]: tuple(r)[1:] for r in steps.stage_durations(log, "at", "id").collect()}
    assert summed == {"a": (4, 0, 1, 1, 14, 9), "b": (3, 1, 1, 0, 7, 7), "c": (1, 0, 0, 1, 0, None)}
    assert steps.stage_durations(log.limit(0), "at").collect() == []


def test_the_same_sample_with_any_partitioning(spark):
    df = spark.range(500).selectExpr("id as a", "cast(id % 3 as string) as b", "id as _row")
    draws = [sorted(tuple(r) for r in sample_values(df.repartition(n), ["a", "b"], 20, position="a").collect()) for n in (1, 5)]
    assert draws[0] == draws[1] and len(draws[0]) == 40
    plain = [sorted(tuple(r) for r in sample_values(df.repartition(n), ["a"], 20).collect()) for n in (2, 7)]
    assert plain[0] == plain[1] != sorted(tuple(r) for r in sample_values(df, ["a"], 20, seed=2).collect())
