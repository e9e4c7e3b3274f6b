"""Streaming roll-up: multi-trigger replace-upsert equals the batch roll-up; late rows
past the watermark are dropped (T1-T4)."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import write_text
from tidewater import store
from tidewater.operators import ingest
from tidewater.schemas import RAW_SALE
from tidewater.streaming import hourly, late


def msg(tid, cat, ts, q="1", p="2.00"):
    return json.dumps({"transaction_id": tid, "product_id": "P", "category_id": cat,
                       "quantity": q, "price_per_unit": p, "timestamp": ts})


def _table(df):
    return {(str(r.time), r.category_id): (float(r.total_sales), r.total_quantity)
            for r in df.collect()}


def test_stream_equals_batch_over_several_triggers(spark, tmpdir_path):
    src = f"{tmpdir_path}/src"
    files = [
        [msg("a", "C1", "2024-01-01T10:05:00"), msg("b", "C1", "2024-01-01T10:50:00")],
        [msg("c", "C1", "2024-01-01T10:59:00"), msg("d", "C2", "2024-01-01T11:10:00")],
        [msg("e", "C1", "2024-01-01T11:30:00", q="3"), msg("f", "C1", "2024-01-01T10:20:00")],
        [msg("g", "C2", "2024-01-01T13:00:00"), msg("h", "C1", "bad")],
    ]
    for i, lines in enumerate(files):
        write_text(f"{src}/part-{i}.json", "\n".join(lines) + "\n")
        t = time.time() - 100 + i
        os.utime(f"{src}/part-{i}.json", (t, t))
    table = f"{tmpdir_path}/table"
    hourly.run_stream_to_table(spark, src, table, f"{tmpdir_path}/ckpt",
                               max_files_per_trigger=1)
    got = _table(hourly.read_stream_table(spark, table))
    batch = spark.read.schema(RAW_SALE).json(src)
    assert got == _table(ingest.hourly_sales(ingest.clean_sales(batch)))
    assert got[("2024-01-01 10:00:00", "C1")] == (8.0, 4)


def test_late_rows_do_not_disturb_on_time_totals(spark, tmpdir_path):
    """Spark guarantees that rows within the watermark are counted; a row later than the
    watermark may or may not be (it is not retracted either). The batch recount over the
    files stays authoritative."""
    src = f"{tmpdir_path}/src"
    write_text(f"{src}/part-0.json", msg("a", "C1", "2024-01-01T10:00:00") + "\n"
               + msg("b", "C1", "2024-01-01T16:00:00") + "\n")
    write_text(f"{src}/part-1.json", msg("late", "C1", "2024-01-01T10:30:00") + "\n")
    t = time.time() - 100
    os.utime(f"{src}/part-0.json", (t, t))
    table = f"{tmpdir_path}/table"
    hourly.run_stream_to_table(spark, src, table, f"{tmpdir_path}/ckpt", watermark="2 hours",
                               max_files_per_trigger=1)
    got = _table(hourly.read_stream_table(spark, table))
    assert got[("2024-01-01 16:00:00", "C1")] == (2.0, 1)
    assert got[("2024-01-01 10:00:00", "C1")] in {(2.0, 1), (4.0, 2)}


def test_replayed_batch_is_idempotent(spark, tmpdir_path):
    import datetime as _dt
    table = f"{tmpdir_path}/table"
    sink = hourly.upsert_batch(table)
    schema = "time timestamp_ntz, category_id string, total_sales decimal(38,12), total_quantity long"
    from decimal import Decimal as D
    b0 = spark.createDataFrame([(_dt.datetime(2024, 1, 1, 10), "C1", D(5), 1),
                                (_dt.datetime(2024, 1, 2, 9), "C2", D(7), 2)], schema)
    b1 = spark.createDataFrame([(_dt.datetime(2024, 1, 1, 10), "C1", D(9), 3)], schema)
    sink(b0, 0)
    sink(b1, 1)
    first = _table(hourly.read_stream_table(spark, table))
    sink(b1, 1)                       # the same batch delivered again after a failure
    assert _table(hourly.read_stream_table(spark, table)) == first
    assert first == {("2024-01-01 10:00:00", "C1"): (9.0, 3),
                     ("2024-01-02 09:00:00", "C2"): (7.0, 2)}


def test_crash_in_the_middle_of_a_write_loses_nothing(spark, tmpdir_path):
    """A batch folder without its marker (the write broke off) is ignored; the replay of the
    batch brings its rows, and the rows of other batches were never touched."""
    import datetime as _dt
    import glob
    from decimal import Decimal as D
    table = f"{tmpdir_path}/table"
    sink = hourly.upsert_batch(table)
    schema = "time timestamp_ntz, category_id string, total_sales decimal(38,12), total_quantity long"
    sink(spark.createDataFrame([(_dt.datetime(2024, 1, 1, 10), "C1", D(5), 1),
                                (_dt.datetime(2024, 1, 1, 11), "C1", D(6), 1)], schema), 0)
    late = spark.createDataFrame([(_dt.datetime(2024, 1, 1, 10), "C1", D(9), 3)], schema)
    sink(late, 1)
    for f in glob.glob(f"{table}/batch=1/_SUCCESS"):
        os.remove(f)
    before = _table(hourly.read_stream_table(spark, table))
    assert before == {("2024-01-01 10:00:00", "C1"): (5.0, 1), ("2024-01-01 11:00:00", "C1"): (6.0, 1)}
    sink(late, 1)
    after = _table(hourly.read_stream_table(spark, table))
    assert after == {**before, ("2024-01-01 10:00:00", "C1"): (9.0, 3)}
    hourly.compact_stream_table(spark, table, f"{tmpdir_path}/compact")
    assert _table(hourly.read_stream_table(spark, f"{tmpdir_path}/compact")) == after


def _deliver(src, *files):
    """Files with rising times, from the number of those already there."""
    at = len(os.listdir(src)) if os.path.isdir(src) else 0
    for i, lines in enumerate(files, at):
        write_text(f"{src}/part-{i}.json", "\n".join(lines) + "\n")
        t = time.time() - 1000 + i
        os.utime(f"{src}/part-{i}.json", (t, t))


def _counted(spark, table):
    return {(str(r.time)[:13], r.category_id): (float(r.total_sales), r.total_quantity, r.late_rows,
                                                float(r.late_sales), r.late_quantity)
            for r in late.read_counted(spark, table).collect()}


def test_late_rows_are_counted_apart(spark, tmpdir_path):
    src, table, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/t/counted", f"{tmpdir_path}/ckpt"
    assert late.read_counted(spark, table) is None
    _deliver(src, [msg("a", "C1", "2024-01-01T10:00:00"), msg("b", "C1", "2024-01-01T16:00:00"),
                   msg("early", "C2", "2023-12-31T10:00:00")],  # first batch: nothing is late
             [msg("late", "C1", "2024-01-01T10:30:00", q="3"), msg("edge", "C1", "2024-01-01T13:59:59"),
              msg("ok", "C1", "2024-01-01T14:00:00"), msg("x", "C1", "2024-01-01T10:30:00", q="-1")],
             [msg("bad", "C1", "no stamp")])
    late.run_counted_stream(spark, src, table, ckpt, max_files_per_trigger=1)
    # newest 16:00, delay 2 h: hours that ended at 14:00 or before are late
    want = {("2024-01-01 10", "C1"): (2.0, 1, 1, 6.0, 3), ("2024-01-01 16", "C1"): (2.0, 1, 0, 0.0, 0),
            ("2023-12-31 10", "C2"): (2.0, 1, 0, 0.0, 0), ("2024-01-01 13", "C1"): (0.0, 0, 1, 2.0, 1),
            ("2024-01-01 14", "C1"): (2.0, 1, 0, 0.0, 0)}
    assert _counted(spark, table) == want
    assert store.progress(spark, table) == {"run": 0, "batch": 2, "note": "2024-01-01 16:00:00"}
    batch = ingest.hourly_sales(ingest.clean_sales(spark.read.schema(RAW_SALE).json(src)))
    assert _table(batch) == {(f"{t}:00:00", c): (v[0] + v[3], v[1] + v[4]) for (t, c), v in want.items()}


def test_batch_delivered_again_adds_nothing_and_new_run_starts_anew(spark, tmpdir_path):
    src, table = f"{tmpdir_path}/src", f"{tmpdir_path}/t/counted"
    _deliver(src, [msg("a", "C1", "2024-01-01T10:00:00")], [msg("b", "C1", "2024-01-01T10:10:00")])
    late.run_counted_stream(spark, src, table, f"{tmpdir_path}/one", max_files_per_trigger=1)
    first = _counted(spark, table)
    again = ingest.clean_sales(spark.read.schema(RAW_SALE).json(f"{src}/part-1.json"))
    late.count_batch(table, 0, "2 hours")(again, 1)
    assert _counted(spark, table) == first == {("2024-01-01 10", "C1"): (4.0, 2, 0, 0.0, 0)}
    late.run_counted_stream(spark, src, table, f"{tmpdir_path}/two")  # the checkpoint was lost
    assert _counted(spark, table) == first
    assert store.progress(spark, table)["run"] == 1
    late.count_batch(table, 0, "2 hours")(again, 7)  # a straggler of the old run
    assert _counted(spark, table) == first
    _deliver(src, [msg("c", "C1", "2024-01-01T10:20:00")])
    late.run_counted_stream(spark, src, table, f"{tmpdir_path}/two")
    assert _counted(spark, table) == {("2024-01-01 10", "C1"): (6.0, 3, 0, 0.0, 0)}


def test_compaction_during_a_stream(spark, tmpdir_path):
    """A batch that is committed while the compaction runs stays; a reader that started before
    it keeps its folders; old manifests and what only they name can be removed."""
    root = f"{tmpdir_path}/t"
    src, table, ckpt = f"{tmpdir_path}/src", f"{root}/counted", f"{tmpdir_path}/ckpt"
    _deliver(src, *[[msg(str(i), "C1", f"2024-01-01T1{i}:00:00")] for i in range(4)])
    late.run_counted_stream(spark, src, table, ckpt, max_files_per_trigger=1)
    reader = late.read_counted(spark, table)
    before = _counted(spark, table)
    _deliver(src, [msg("z", "C2", "2024-01-01T13:30:00")])

    def slow(rows):
        late.run_counted_stream(spark, src, table, ckpt)
        return rows.groupBy("time", "category_id", "late").agg(
            *[F.sum(c).alias(c) for c in ("n", "sales", "quantity")], F.max("newest").alias("newest"))

    assert store.compact(spark, table, slow) > 0
    after = {**before, ("2024-01-01 13", "C2"): (2.0, 1, 0, 0.0, 0)}
    assert _counted(spark, table) == after
    assert len(store.manifest(spark, root)[1]["counted"]) == 2
    assert len(reader.collect()) == len(before)
    assert late.compact_counted(spark, table) > 0 and late.compact_counted(spark, table) == 0
    assert store.drop_old_manifests(spark, root, keep=1) == 6
    assert _counted(spark, table) == after and store.progress(spark, table)["batch"] == 4
    assert len([d for d in os.listdir(table) if d.startswith("gen=")]) == 1
    assert store.drop_old_manifests(spark, root, keep=1) == 0


def test_compaction_of_a_replaced_table_is_refused(spark, tmpdir_path):
    src, table = f"{tmpdir_path}/src", f"{tmpdir_path}/t/counted"
    _deliver(src, *[[msg(str(i), "C1", f"2024-01-01T1{i}:00:00")] for i in range(2)])
    late.run_counted_stream(spark, src, table, f"{tmpdir_path}/one", max_files_per_trigger=1)

    def slow(rows):
        late.run_counted_stream(spark, src, table, f"{tmpdir_path}/two")
        return rows

    with pytest.raises(store.Conflict):
        store.compact(spark, table, slow)
    assert sum(v[0] for v in _counted(spark, table).values()) == 4.0


def test_lost_checkpoint_does_not_hide_new_totals(spark, tmpdir_path):
    """Batch ids start at 0 again with a new checkpoint; the newer run wins all the same."""
    src, table = f"{tmpdir_path}/src", f"{tmpdir_path}/table"
    _deliver(src, *[[msg(str(i), "C1", f"2024-01-01T10:0{i}:00")] for i in range(3)])
    hourly.run_stream_to_table(spark, src, table, f"{tmpdir_path}/one", max_files_per_trigger=1)
    assert _table(hourly.read_stream_table(spark, table)) == {("2024-01-01 10:00:00", "C1"): (6.0, 3)}
    _deliver(src, [msg("x", "C1", "2024-01-01T10:30:00")])
    hourly.run_stream_to_table(spark, src, table, f"{tmpdir_path}/two")
    assert _table(hourly.read_stream_table(spark, table)) == {("2024-01-01 10:00:00", "C1"): (8.0, 4)}
