import time

import pytest
from pyspark.errors import StreamingQueryException
from test_changes import ENTRIES, ROUTE, final, log, message, rows

from tidegate.operators.catalog import COLUMNS_DDL
from tidegate.plans import apply_day, repair
from tidegate.sources import bronze, debezium
from tidegate.sources.keyed_table import KeyedTable
from tidegate.streaming import apply, control, drift


def write(spark, path, entries, start=0):
    log(spark, entries, start).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, table, **policy):
    stream = bronze.table_stream(spark, f"{tmp_path}/log", max_files_per_trigger=1)
    query = apply.start(stream, table, f"{tmp_path}/checkpoint", drain=True, **policy)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    seen = {}
    for start in (0, 4, 7):
        end = {0: 4, 4: 7, 7: 10}[start]
        write(spark, f"{tmp_path}/log", ENTRIES[start:end], start)
        run(spark, tmp_path, table, skip_bad=True, on_counts=seen.__setitem__)
    assert rows(table.read()) == final(spark, ENTRIES)
    assert sum(c["consumed"] for c in seen.values()) == len(ENTRIES)
    assert sum(c["quarantined"] for c in seen.values()) == 1


def test_an_unreadable_message_stops_the_stream_and_publishes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    write(spark, f"{tmp_path}/log", ENTRIES[:6])
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, table)
    assert table.batches() == []
    # the same checkpoint goes on once the policy lets it
    run(spark, tmp_path, table, skip_bad=True)
    assert [n for _, n in table.batches()] == [0] and table.quarantine().count() == 1


def test_a_stream_reads_what_bronze_keeps(spark, tmp_path):
    bronze.append(debezium.decode(log(spark, ENTRIES)), f"{tmp_path}/log")
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    run(spark, tmp_path, table, skip_bad=True, compact_every=2)
    assert rows(table.read()) == final(spark, ENTRIES)
    with pytest.raises(ValueError):
        bronze.table_stream(spark, f"{tmp_path}/log", startup="timestamp")
    with pytest.raises(ValueError):
        bronze.table_stream(spark, f"{tmp_path}/log", startup="latest")  # nothing would keep the position


def test_a_start_at_the_latest_record_is_settled_once(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    append = lambda entries, start: bronze.append(debezium.decode(log(spark, entries, start)), f"{tmp_path}/log")

    def once(**kind):
        stream = bronze.table_stream(spark, f"{tmp_path}/log", checkpoint=f"{tmp_path}/c", **kind)
        apply.start(stream, table, f"{tmp_path}/c", drain=True, skip_bad=True).awaitTermination()

    append(ENTRIES[:1], 0)
    once(startup="latest")
    assert rows(table.read()) == []
    append(ENTRIES[1:2], 1)  # while the stream is down
    once(startup="latest")
    assert rows(table.read()) == [(2, "y", 2)]
    append(ENTRIES[7:8], 7)
    once(startup="earliest")  # the record counts, not the argument
    assert rows(table.read()) == [(2, "y", 2), (4, "q", 4)]


def test_another_checkpoint_is_another_stream(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    for n, checkpoint in enumerate("ab"):
        write(spark, f"{tmp_path}/log{checkpoint}", ENTRIES[n : n + 1], n)
        stream = bronze.table_stream(spark, f"{tmp_path}/log{checkpoint}")
        apply.start(stream, table, f"{tmp_path}/{checkpoint}", drain=True).awaitTermination()
    assert [n for _, n in table.batches()] == [0, 0]
    assert rows(table.read()) == [(1, "x", 1), (2, "y", 2)]


def test_drains_end_when_idle_or_by_time_with_offsets_intact(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    for n in range(6):
        write(spark, f"{tmp_path}/log", ENTRIES[n : n + 1], n)
    slow = lambda raw, batch: time.sleep(0.7)
    start = lambda **k: apply.start(
        bronze.table_stream(spark, f"{tmp_path}/log", max_files_per_trigger=1), table, f"{tmp_path}/c", interval="0 seconds", skip_bad=True, **k
    )
    first = control.drain(start(before=slow), idle=60, longest=4)
    assert first.reason == "time" and first.seconds < 30
    done = len(table.batches())
    assert 0 < done < 6  # whole batches only
    second = control.drain(start(), idle=1.5, longest=120)
    assert second.reason == "idle" and len(table.batches()) == 6
    assert first.rows + second.rows == 6 and second.batches == 6 - done
    assert rows(table.read()) == final(spark, ENTRIES[:6])
    ended = apply.start(bronze.table_stream(spark, f"{tmp_path}/log"), table, f"{tmp_path}/c", drain=True, skip_bad=True)
    assert control.drain(ended, idle=60).reason == "finished"


def test_supervision_gives_up_where_the_gate_stays_shut(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    write(spark, f"{tmp_path}/log", ENTRIES[:2])
    guard = drift.guard(columns(spark, "id", "a"), lambda: columns(spark, "id", "a", "b"), "canal")
    start = lambda: apply.start(bronze.table_stream(spark, f"{tmp_path}/log"), table, f"{tmp_path}/c", drain=True, before=guard)
    mend = lambda query: repair.repair(
        query, columns(spark, "id", "a"), lambda: columns(spark, "id", "a", "b"), lambda: store(spark, "id", "a"),
        lambda plan: None, start, "canal",
    )
    report = repair.supervise(start, mend, lambda: False)
    assert report.blocked and report.steps == ["stopped", "evolved", "blocked"] and table.batches() == []
    broken = lambda: apply.start(bronze.table_stream(spark, f"{tmp_path}/log"), table, f"{tmp_path}/c", drain=True, before=lambda raw, batch: 1 / 0)
    with pytest.raises(StreamingQueryException, match="division"):
        repair.supervise(broken, mend, lambda: False)


def columns(spark, *names):
    rows_ = [("d", "s", "t", n, i + 1, "int", "int(11)", None, True, None, 10, 0, "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows_, COLUMNS_DDL)


def test_drift_stops_the_stream(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    write(spark, f"{tmp_path}/log", ENTRIES[:2])
    guard = drift.guard(columns(spark, "id", "a"), lambda: columns(spark, "id", "a", "b"), "canal")
    with pytest.raises(StreamingQueryException, match="differs"):
        run(spark, tmp_path, table, before=guard)
    assert table.batches() == []


def store(spark, *names):
    rows_ = [("d", "s", "t", n, i + 1, "int", "INT", None, True, None, None, None, "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows_, COLUMNS_DDL)


def test_repair_evolves_before_the_gate(spark):
    target = {"names": ("id", "a")}
    seen = []

    def evolve(plan):
        seen.extend((r.action, r.column_name, r.to_type) for r in plan.collect())
        target["names"] = ("id", "a", "b")

    call = lambda change: repair.repair(
        None, columns(spark, "id", "a"), lambda: columns(spark, "id", "a", "b"),
        lambda: store(spark, *target["names"]), change, lambda: "running", "canal",
    )
    report = call(evolve)
    assert seen == [("add", "b", "INT")]
    assert report.steps == ["stopped", "evolved", "resumed"] and report.query == "running"
    target["names"] = ("id",)
    assert call(lambda plan: None).steps == ["stopped", "evolved", "blocked"]


def test_replay_backfills_from_a_record_time(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    raw = log(spark, [(message("c", {"id": 1, "a": "x", "b": 1}), 1)])
    apply_day.replay(raw, ROUTE, table, since_ms=5_000_001)
    assert rows(table.read()) == []
    apply_day.replay(raw, ROUTE, table, since_ms=5_000_000)
    assert rows(table.read()) == [(1, "x", 1)]
    assert apply_day.replay(raw, ROUTE, table, 5_000_000, "again") == apply_day.replay(raw, ROUTE, table, 5_000_000, "again")
    assert len(table.batches()) == 3  # two replays without a name, one with


def test_source_options():
    assert bronze.kafka_options("h:1", ["a", "b"])["startingOffsets"] == "latest"
    dated = bronze.kafka_options("h:1", ["a"], "timestamp", 5, 1000)
    assert dated["startingTimestamp"] == "5" and dated["maxOffsetsPerTrigger"] == "1000"
    for bad in ({"startup": "sometime"}, {"startup": "timestamp"}):
        with pytest.raises(ValueError):
            bronze.kafka_options("h:1", ["a"], **bad)
