"""Two writers, lost writers: the latest run never moves back and no half-written run stays."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from agropanel import schema as sc
from agropanel.sources import pointer, readers, sinks

ROWS = "district_id int, value double"
STORED = sc.struct(district_id=sc._I, value=sc._D, run_id=sc._S)


def publish(spark, root, run, finished, failing=False):
    rows = spark.createDataFrame([(1, float(len(run)))], ROWS)
    found = spark.createDataFrame([("c", "fail" if failing else "pass", "x", None)], "check_name string, status string, detail string, override_ref string")
    return sinks.publish(spark, root, {"out": lambda _run, _prev: rows}, lambda _run: found, "v", "2026-10-01", "2026-10-01 01:00:00",
                         finished, run_id=run)


def state(spark, root):
    return {r["run_id"]: r["status"] for r in sinks.run_state(spark.read.schema(sc.RUNS).parquet(f"{root}/runs")).collect()}


def test_place_is_exclusive(spark, tmp_path):
    def one(i):
        source = f"file://{tmp_path}/s{i}"
        pointer._write(spark, source, str(i))
        return pointer.place(spark, source, f"file://{tmp_path}/t")

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(one, range(16))) == 1


def test_no_step_back(spark, tmp_path):
    root = str(tmp_path)
    assert pointer.latest(spark, root) is None
    assert pointer.of_latest(spark, root, "out", STORED).count() == 0
    assert pointer.advance(spark, root, "b", "2026-01-02 00:00:00")
    assert not pointer.advance(spark, root, "a", "2026-01-01 00:00:00")
    assert not pointer.advance(spark, root, "b", "2026-01-02 00:00:00")
    assert pointer.advance(spark, root, "c", "2026-01-02 00:00:00")
    assert pointer.latest(spark, root) == (1, {"run_id": "c", "finished_at": "2026-01-02 00:00:00"})


def test_race_of_many(spark, tmp_path):
    root = str(tmp_path)
    times = [f"2026-01-{d:02d} 00:00:00" for d in range(1, 21)]
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda t: pointer.advance(spark, root, f"run {t}", t), reversed(times)))
    assert won[0] or any(won)
    number, now = pointer.latest(spark, root)
    assert now["finished_at"] == times[-1] and number == sum(won) - 1


def test_two_publishers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda d: publish(spark, root, f"run-{d}", f"2026-10-0{d} 02:00:00"), (4, 1, 3, 2)))
    assert {s for _, s in done} == {"ok"}
    assert state(spark, root) == {f"run-{d}": "ok" for d in (1, 2, 3, 4)}
    assert pointer.latest(spark, root)[1]["run_id"] == "run-4"
    assert spark.read.schema(STORED).parquet(f"{root}/out").count() == 4
    assert [r["run_id"] for r in pointer.of_latest(spark, root, "out", STORED).collect()] == ["run-4"]
    # a flagged run does not become the latest
    assert publish(spark, root, "late", "2026-11-01 02:00:00", failing=True) == ("late", "flagged")
    assert pointer.latest(spark, root)[1]["run_id"] == "run-4"


@pytest.mark.parametrize("at", ["tables", "pointer"])
def test_lost_writer(spark, tmp_path, monkeypatch, at):
    root = f"file://{tmp_path}/runs"
    publish(spark, root, "a", "2026-10-01 02:00:00")

    class Lost(BaseException):
        """Nothing of the writer runs after this."""

    def gone(*_args, **_more):
        raise Lost

    with monkeypatch.context() as m:
        if at == "tables":
            append = sinks.append_run

            def half(df, path, run_id):
                append(df, path, run_id)
                raise Lost

            m.setattr(sinks, "append_run", half)
        else:
            m.setattr(pointer, "advance", gone)
        with pytest.raises(Lost):
            publish(spark, root, "b", "2026-10-02 02:00:00")
    assert pointer.latest(spark, root)[1]["run_id"] == "a"
    # a writer that may still be at work is left alone
    early = pointer.recover(spark, root, "2026-09-30 00:00:00", "2026-10-03 00:00:00", ("out", "sanity_checks"))
    assert early["closed"] == [] and early["swept"] == []
    found = pointer.recover(spark, root, "2026-10-02 12:00:00", "2026-10-03 00:00:00", ("out", "sanity_checks"))
    if at == "tables":
        assert found == {"closed": ["b"], "swept": ["b"], "pointed": []}
        assert state(spark, root) == {"a": "ok", "b": "failed"}
        assert spark.read.schema(STORED).parquet(f"{root}/out").select("run_id").distinct().count() == 1
        assert pointer.latest(spark, root)[1]["run_id"] == "a"
    else:
        assert early["pointed"] == ["b"] and found["pointed"] == []
        assert state(spark, root) == {"a": "ok", "b": "ok"}
        assert pointer.latest(spark, root)[1]["run_id"] == "b"
    again = pointer.recover(spark, root, "2026-10-02 12:00:00", "2026-10-03 00:00:00", ("out", "sanity_checks"))
    assert again == {"closed": [], "swept": [], "pointed": []}
    assert readers.exists(spark, f"{root}/out/run_id=a")
