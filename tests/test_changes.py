import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators import changes as ch
from tidegate.operators.changes import Route
from tidegate.plans import apply_day
from tidegate.sources import bronze, debezium, keyed_table
from tidegate.sources.keyed_table import KeyedTable
from tidegate.streaming.apply import decode

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("a", T.StringType()),
        T.StructField("b", T.IntegerType()),
    ]
)
ROUTE = Route("shop.public.t", "t", ("id",), SCHEMA)


def message(op, after=None, before=None, ts_ms=1_000, **more):
    return json.dumps({"payload": {"op": op, "before": before, "after": after, "ts_ms": ts_ms, **more}})


def log(spark, entries, start=0):
    """entries: (value text, key id or None); one partition, offsets in order."""
    rows = [
        (ROUTE.topic, 0, start + n, None if key is None else json.dumps({"payload": {"id": key}}), value)
        for n, (value, key) in enumerate(entries)
    ]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, key string, value string")
    return df.withColumn("timestamp", F.timestamp_millis(F.lit(5_000_000))).select(*bronze.RAW_SCHEMA.fieldNames())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def final(spark, entries):
    changes = ch.project(decode(log(spark, entries), ROUTE), ROUTE)
    return rows(ch.visible(ch.latest(changes, ["id"], ROUTE.values, ch.truncate_epoch(changes))))


def test_decode_cases(spark):
    cases = [
        message("u", {"id": 1, "product": "demo"}, None, 1788105600123, source={"ts_ms": 1788105600000}),
        json.dumps({"op": "d", "before": {"id": 1}, "after": None, "ts_ms": 1788105600999}),
        json.dumps({"op": "c", "after": {"id": 1}, "source": {"ts_ms": 7}}),
        json.dumps({"op": "c", "after": {"id": 1}, "ts_ms": 0}),
        json.dumps({"payload": "{}", "op": "r", "after": {"id": 1}, "ts_ms": 3}),
    ]
    decoded = debezium.decode(log(spark, [(c, 1) for c in cases])).orderBy("offset")
    assert [(r.op, r.event_ms) for r in decoded.select("op", "event_ms").collect()] == [
        ("u", 1788105600123), ("d", 1788105600999), ("c", 7), ("c", 5_000_000), ("r", 3),
    ]


@pytest.mark.parametrize(
    ("value", "key", "action"),
    [
        (None, 1, "bad_message"), ("", 1, "bad_message"), ("{bad", 1, "bad_message"), ("[1]", 1, "bad_message"),
        ("1", 1, "bad_message"), (message("c"), 1, "no_after"), (message("c", {}), 1, "no_after"),
        (message("t"), None, "truncate"), (message("x", {"id": 1}), 1, "unknown_op"),
        (json.dumps({"after": {"id": 1}}), 1, "unknown_op"), (message("d"), None, "bad_message"),
        (message("d", None, {"id": 1}), None, "delete"), (message("d"), 1, "delete"),
        (message("d", None, {"b": 1}), None, "bad_message"), (message("u", {"id": 1}), 1, "upsert"),
    ],
)
@pytest.mark.parametrize("columns", [None, ["id", "a", "b"]])
def test_actions(spark, value, key, action, columns):
    decoded = debezium.decode(log(spark, [(value, key)]), columns)
    assert debezium.classify(decoded, keys=["id"]).select("action").first()[0] == action


def test_delete_without_configured_or_named_key_is_rejected(spark):
    decoded = debezium.decode(log(spark, [(message("d", None, {"id": 1}), None), (message("d"), 2)]))
    actions = [r.action for r in debezium.classify(decoded).orderBy("offset").collect()]
    assert actions == ["bad_message", "delete"]


def test_truncate_prefilter_keeps_every_truncate(spark):
    texts = [message("t"), '{"op":"\\u0074"}', message("c", {"id": 1})]
    kept = log(spark, [(t, None) for t in texts]).where(debezium.may_truncate(F.col("value")))
    assert sorted(r.offset for r in kept.collect()) == [0, 1]


def test_change_order_wins(spark):
    full = lambda key, a, b: (message("c", {"id": key, "a": a, "b": b}), key)
    assert final(spark, [full(1, "x", 1), (message("d"), 1), full(1, "y", 2)]) == [(1, "y", 2)]
    assert final(spark, [full(1, "x", 1), (message("t"), None), full(2, "z", 3)]) == [(2, "z", 3)]
    # a moved key arrives as a delete and a create
    assert final(spark, [full(1, "x", 1), (message("d"), 1), full(9, "x", 1)]) == [(9, "x", 1)]
    assert final(spark, [full(1, "x", 1), full(1, "x", 1)]) == [(1, "x", 1)]


def test_partial_upserts(spark):
    start = (message("c", {"id": 1, "a": "x", "b": 1}), 1)
    assert final(spark, [start, (message("u", {"id": 1, "b": None}), 1)]) == [(1, "x", None)]
    # nothing of the time before a delete comes back
    assert final(spark, [start, (message("d"), 1), (message("c", {"id": 1, "b": 5}), 1)]) == [(1, None, 5)]


def test_values_that_do_not_fit_leave_the_older_row(spark):
    start = (message("c", {"id": 1, "a": True, "b": 1}), 1)
    assert final(spark, [start, (message("u", {"id": 1, "b": "many"}), 1)]) == [(1, "1", 1)]
    assert final(spark, [start, (message("u", {"a": "no key"}), None)]) == [(1, "1", 1)]
    assert final(spark, [(message("c", {"id": 1, "a": {"k": [1]}}), 1)]) == [(1, '{"k":[1]}', None)]


ENTRIES = [
    (message("c", {"id": 1, "a": "x", "b": 1}), 1), (message("c", {"id": 2, "a": "y", "b": 2}), 2),
    (message("u", {"id": 1, "b": 7}), 1), (message("d"), 2), ("{bad", None),
    (message("c", {"id": 3, "a": "old", "b": 0}, ts_ms=1_500), 3), (message("t", ts_ms=2_000), None),
    (message("c", {"id": 4, "a": "q", "b": 4}, ts_ms=3_000), 4),
    (message("c", {"id": 1, "b": 9}, ts_ms=3_000), 1), (message("u", {"id": 4, "a": None}, ts_ms=4_000), 4),
]


@pytest.mark.parametrize("split", [[10], [3, 7], [1, 4, 5], [2, 2, 2, 2, 2]])
@pytest.mark.parametrize("compact", [False, True])
def test_any_split_into_batches_gives_the_same_state(spark, tmp_path, split, compact):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=4)
    start = 0
    for batch, size in enumerate(split):
        changes = ch.project(decode(log(spark, ENTRIES[start : start + size], start), ROUTE), ROUTE)
        table.append(batch, changes)
        table.append(batch, changes)  # delivered twice
        if compact:
            table.compact()
        start += size
    assert rows(table.read()) == final(spark, ENTRIES) == [(1, None, 9), (4, None, 4)]
    assert [r["_reason"] for r in table.quarantine().collect()] == ["not a JSON object"]


def test_replayed_changes_do_not_undo_newer_ones(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    project = lambda entries, start: ch.project(decode(log(spark, entries, start), ROUTE), ROUTE)
    table.append(0, project(ENTRIES[:3], 0))
    table.compact()
    table.append(1, project(ENTRIES[:1], 0))
    assert rows(table.read()) == [(1, "x", 7), (2, "y", 2)]


def test_the_event_time_alone_is_that_of_the_whole_decoding(spark):
    wrapped = [f'{{"payload":{v}}}' for v in ('{"ts_ms":5}', '{"ts_ms":0,"source":{"ts_ms":7,"lsn":"x"}}', "[1]", '{"ts_ms":"a","op":1,"after":3}')]
    texts = ['{"ts_ms":5,"op":"c","after":{"id":1}}', '{"source":{"ts_ms":6}}', '{"ts_ms":5', "[1]", "", None, '{"ts_ms":"a"}', '{"payload":1,"ts_ms":8}', *wrapped]
    raw = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "offset bigint, value string").selectExpr(
        "'t' as topic", "0 as partition", "offset", "timestamp_millis(900 + offset) as timestamp", "cast(null as string) as key", "value"
    )
    times = [{r["offset"]: r["event_ms"] for r in df.collect()} for df in (debezium.with_event_time(raw), debezium.decode(raw))]
    assert times[0] == times[1] and times[0][0] == 5 and times[0][2] == 902


def test_the_problems_of_a_change_are_listed_once(spark):
    plan = ch.project(decode(log(spark, ENTRIES[:2], 0), ROUTE), ROUTE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1


def test_a_run_is_found_by_its_folder_and_not_sent_to_one_task(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=4)
    table.append(0, ch.project(decode(log(spark, ENTRIES[:5], 0), ROUTE), ROUTE))
    plans, merge = [table.changes()._jdf.queryExecution().optimizedPlan().toString()], ch.merge
    monkeypatch.setattr(
        ch, "merge", lambda old, news, *rest: plans.append(news._jdf.queryExecution().optimizedPlan().toString()) or merge(old, news, *rest)
    )
    table.compact()
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert table.changes().isEmpty() and rows(table.read()) == final(spark, ENTRIES[:5])


def test_unpublished_work_is_not_read(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=4)
    table.append(0, changes_of(spark, ENTRIES[:2]))
    # a run and a version that died before their rows of commits and folds were written
    kept, table._add = table._add, lambda *row: None
    table.append(1, changes_of(spark, ENTRIES[2:4], 2))
    table.compact()
    table._add = kept
    assert table.batches() == [("batches", 0)] and table.version() is None
    assert rows(table.read()) == [(1, "x", 1), (2, "y", 2)]
    table.append(1, changes_of(spark, ENTRIES[2:4], 2))
    assert table.compact() == 0
    assert rows(table.read()) == [(1, "x", 7)]


def test_part_count_may_change(spark, tmp_path):
    for batch, parts in enumerate((3, 8, 5)):
        table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts)
        start = batch * 2
        table.append(batch, changes_of(spark, ENTRIES[start : start + 2], start))
        assert table.compact() == batch
        assert rows(table.read()) == final(spark, ENTRIES[: start + 2])
    table.expire(keep=1)
    assert rows(table.read()) == final(spark, ENTRIES[:6])
    assert table.quarantine().count() == 1
    table.append(3, changes_of(spark, ENTRIES[6:], 6))
    assert rows(table.read()) == final(spark, ENTRIES)


def test_one_changed_key_rewrites_one_part(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=16)
    every = [(message("c", {"id": k, "a": f"x{k}", "b": k}), k) for k in range(200)]
    table.append(0, changes_of(spark, every))
    table.compact()
    before = table.layout()
    assert set(before) == set(range(16)) and len(set(before.values())) == 1
    table.append(1, changes_of(spark, [(message("u", {"id": 77, "b": -1}), 77)], 200))
    # what the fold reads of the state: one part of it
    part = spark.createDataFrame([(77,)], "id long").select(table._part(16)).first()[0]
    read = [r[0] for r in table._snapshot({part: before[part]}).select(F.input_file_name()).distinct().collect()]
    assert table.compact() == 1
    after = table.layout()
    assert [p for p in after if after[p] != before[p]] == [part] and len(after) == 16
    assert os.listdir(f"{tmp_path}/t/state/_fold={after[part]}") == [f"_part={part}"]
    assert read and all(f"_part={part}/" in f for f in read)
    assert rows(table.read()) == sorted((k, f"x{k}", -1 if k == 77 else k) for k in range(200))


def test_streams_that_number_alike_do_not_meet(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=4)
    table.append(0, changes_of(spark, ENTRIES[:1]), "one")
    table.append(0, changes_of(spark, ENTRIES[1:2], 1), "two")
    table.append(0, changes_of(spark, ENTRIES[1:2], 1), "two")
    assert table.batches() == [("one", 0), ("two", 0)]
    for _ in range(2):
        assert rows(table.read()) == [(1, "x", 1), (2, "y", 2)]
        table.compact()
    assert table.batches() == []


def test_columns_added_and_widened_between_batches(spark, tmp_path):
    narrow = Route(ROUTE.topic, "t", ("id",), T.StructType.fromDDL("id int, b int"))
    wide = Route(ROUTE.topic, "t", ("id",), T.StructType.fromDDL("id bigint, b bigint, a string"))
    old = KeyedTable(spark, f"{tmp_path}/t", narrow, parts=4)
    project = lambda route, entries, start: ch.project(decode(log(spark, entries, start), route), route)
    old.append(0, project(narrow, ENTRIES[:2], 0))
    old.compact()
    old.append(1, project(narrow, [(message("c", {"id": 5, "b": 5}), 5), (message("c", {"id": 6, "b": 6}), 6)], 2))
    new = KeyedTable(spark, f"{tmp_path}/t", wide, parts=4)
    new.append(2, project(wide, [(message("u", {"id": 6, "b": 2**40}), 6), (message("c", {"id": 2**33, "a": "z"}), 2**33)], 4))
    expected = [(1, 1, None), (2, 2, None), (5, 5, None), (6, 2**40, None), (2**33, None, "z")]
    for _ in range(2):
        assert rows(new.read()) == expected
        new.compact()


def test_day_job_is_repeatable_and_counts(spark, tmp_path):
    noon = 1788192000000 + 12 * 3_600_000
    entries = [
        (message("c", {"id": 1, "a": "x", "b": 1}, ts_ms=noon), 1),
        (message("c", {"id": 2, "a": "y", "b": 2}, ts_ms=1788278400000), 2),
        ("{bad", None), (message("d", ts_ms=noon), 7),
    ]
    bronze.append(debezium.decode(log(spark, entries)), f"{tmp_path}/bronze")
    run = lambda day, **k: apply_day.run(spark, f"{tmp_path}/bronze", [ROUTE], f"{tmp_path}/out", day, **k)
    counted = run("2026-09-01", dry_run=True)["t"]
    assert (counted["consumed"], counted["out_of_window"], counted["upsert"], counted["delete"]) == (3, 1, 1, 1)
    table = KeyedTable(spark, f"{tmp_path}/out/t", ROUTE)
    assert table.batches() == []
    for _ in range(2):
        assert run("2026-09-01")["t"] == counted | {"rejected": 0}
        assert rows(table.read()) == [(1, "x", 1)]
    # the event of the next day was kept, not lost
    run("2026-09-02")
    assert rows(table.read()) == [(1, "x", 1), (2, "y", 2)]


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    changes = ch.project(decode(log(spark, ENTRIES), ROUTE), ROUTE)
    plan = ch.fold(changes, ["id"], ROUTE.values)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning")


def changes_of(spark, entries, start=0):
    return ch.project(decode(log(spark, entries, start), ROUTE), ROUTE)


def test_batches_below_the_snapshot_take_effect(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    table.append(20240110, changes_of(spark, ENTRIES[:1]))
    table.compact()
    table.append(20240110, changes_of(spark, ENTRIES[:2]))  # the day again, with a late row
    assert rows(table.read()) == [(1, "x", 1), (2, "y", 2)]
    table.compact()
    table.append(20240109, changes_of(spark, ENTRIES[2:4], 2))  # a day before it
    for _ in range(3):
        expected = final(spark, ENTRIES[:4])
        assert rows(table.read()) == expected
        table.compact()
        table.expire(keep=1)
    assert rows(table.read()) == expected


def test_files_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_table, "SMALL_FILES", 3)
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE, parts=2)
    for batch in range(8):
        table.append(batch, changes_of(spark, [ENTRIES[batch % len(ENTRIES)]], batch))
        table.compact()
        assert rows(table.read()) == final(spark, ENTRIES[: batch + 1])
    files = {n: [f for _, _, names in os.walk(tmp_path / "t" / n) for f in names if f.endswith(".parquet")] for n in os.listdir(tmp_path / "t")}
    assert len(files["commits"]) <= 5 and len(files["folds"]) <= 5 and len(files["state"]) <= 6
    usable = [d for d, _, names in os.walk(tmp_path / "t/changes") if d.endswith("_usable=true") and names]
    assert len(usable) == 1 and table.quarantine().count() == 1


@pytest.mark.parametrize("compact", [False, True])
def test_a_truncate_outlives_compaction(spark, tmp_path, compact):
    table = KeyedTable(spark, f"{tmp_path}/t", ROUTE)
    entries = [
        (message("c", {"id": 1, "a": "x", "b": 1}), 1), (message("t", ts_ms=2_000), None),
        (message("c", {"id": 2, "a": "y", "b": 2}, ts_ms=3_000), 2),
    ]
    late = log(spark, [(message("c", {"id": 3, "a": "late", "b": 3}, ts_ms=1_500), 3)]).withColumn("partition", F.lit(1))
    table.append(0, changes_of(spark, entries))
    if compact:
        table.compact()
    table.append(1, ch.project(decode(late, ROUTE), ROUTE))  # from before the truncate, of another partition
    if compact:
        table.compact()
    assert [r[0] for r in rows(table.read())] == [2]


def test_a_day_of_another_zone_is_whole(spark, tmp_path):
    noon = 1788192000000 + 12 * 3_600_000
    entries = [
        (message("c", {"id": 1, "a": "x", "b": 1}, ts_ms=noon), 1),
        (message("c", {"id": 2, "a": "y", "b": 2}, ts_ms=noon + 10 * 3_600_000), 2),  # the next day in Shanghai
    ]
    bronze.append(debezium.decode(log(spark, entries)), f"{tmp_path}/bronze")
    counted = apply_day.run(spark, f"{tmp_path}/bronze", [ROUTE], f"{tmp_path}/out", "2026-09-01", zone="UTC")
    assert counted["t"]["upsert"] == 2


def test_whole_images_are_found_by_one_comparison(spark):
    whole = dataclasses.replace(ROUTE, whole_images=True)
    full = lambda key, a, b: (message("c", {"id": key, "a": a, "b": b}), key)
    entries = [full(1, "x", 1), full(2, "y", 2), (message("u", {"id": 1, "b": 9}), 1), full(1, "z", None), (message("d"), 2), full(3, None, 3)]
    changes = ch.project(decode(log(spark, entries), whole), whole)
    assert [r["_reason"] for r in changes.where(F.col(ch.ACTION) == "rejected").collect()] == ["a: not in the image"]
    found = ch.latest(changes, ["id"], whole.values, None, True)
    assert rows(ch.visible(found)) == [(1, "z", None), (3, None, 3)]
    accepted = changes.where(F.col(ch.ACTION) != "rejected")
    assert rows(found.drop(ch.ORDER)) == rows(ch.latest(accepted, ["id"], whole.values).drop(ch.ORDER))
