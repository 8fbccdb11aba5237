"""Streams in several batches: bounded custom state, measured lateness, and runs that are broken off and taken up again."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.session import Scratch
from tessera.streaming import events as module

MINUTE = 60


def events_of(spark, rows):
    """``(event_id, user_id, event_type, seconds)`` as a table of events."""
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "event_id long, user_id long, event_type string, s long, value double")
    return df.select("event_id", "user_id", "event_type", "value", F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz").alias("ts"))


def brute_abandoned(rows, within, watermark):
    bought = {}
    for _, u, kind, s in rows:
        if kind == "purchase":
            bought.setdefault(u, []).append(s)
    return sorted((u, e) for e, u, kind, s in rows if kind == "view" and s + within <= watermark and not any(s < b <= s + within for b in bought.get(u, [])))


def run_abandoned(spark, deliveries, minutes, late_minutes, scratch=None):
    """What the deliveries put out, and the state's rows after each."""
    scratch = scratch or Scratch(spark, "abandoned-test")
    state = []
    for d in deliveries:
        d.write.mode("append").parquet(f"{scratch.root}/in")
        stream = streaming.abandoned(streaming.event_stream(spark, f"{scratch.root}/in", f"{late_minutes} minutes"), minutes)
        query = module._run(stream, f"{scratch.root}/out", f"{scratch.root}/state", "append")
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(map(tuple, module.put_out(spark, stream, f"{scratch.root}/out").collect())), state


def test_abandoned_views_in_many_deliveries(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(4), r.choice(["view", "view", "purchase"]), i * 40 + r.randrange(30)) for i in range(600)]
    deliveries = [events_of(spark, rows[i : i + 200]) for i in range(0, 600, 200)]
    got, _ = run_abandoned(spark, deliveries, 5, 2)
    newest = max(s for *_, s in rows)
    assert got == brute_abandoned(rows, 5 * MINUTE, newest - 2 * MINUTE)


def kept_of(spark, scratch, name):
    """What a state variable of the run holds for each user."""
    state = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true").load(f"{scratch.root}/state")
    out = {}
    for r in state.select("key.user_id").collect():
        out[r.user_id] = out.get(r.user_id, 0) + 1
    return out


def test_state_goes_of_who_only_buys_and_of_many_views(spark):
    bought = [(i, 1, "purchase", i) for i in range(2000)]
    seen = [(10_000 + i, 3, "view", i) for i in range(10_000)] + [(30_000 + i, 3, "purchase", i * 1000 + 500) for i in range(10)]
    later = [(50_000, 2, "view", 10**6)]
    scratch = Scratch(spark, "abandoned-test")
    first, _ = run_abandoned(spark, [events_of(spark, bought + seen)], 30, 200, scratch)
    assert not first and kept_of(spark, scratch, "bought") == {1: 2000, 3: 10} and kept_of(spark, scratch, "views") == {3: 10_000}
    got, rows = run_abandoned(spark, [events_of(spark, later)], 30, 200, scratch)
    assert got == brute_abandoned(bought + seen + later, 30 * MINUTE, 10**6 - 200 * MINUTE)
    assert kept_of(spark, scratch, "bought") == {} and kept_of(spark, scratch, "views") == {2: 1} and rows[-1] < 6


def test_a_user_has_one_timer(spark):
    class Handle:
        timers: set = set()

        def registerTimer(self, ms):
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    class Value:
        held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

    p = module._Abandoned(5)
    p.handle, p.due = Handle(), Value()
    for at in (100, 50, 70, 20):
        p.wake(at * 1_000_000)
    assert p.handle.timers == {(20 + 300) * 1000}


@pytest.fixture
def shuffled(spark):
    """Events in twelve files, each late by up to two files, and their rows."""
    r = random.Random(8)
    rows = [(i, i % 5, r.choice("ab"), i * 600) for i in range(1200)]
    scratch = Scratch(spark, "shuffled")
    order = [0, 2, 1, 3, 5, 4, 6, 7, 10, 8, 9, 11]
    for k in order:
        events_of(spark, rows[k * 100 : k * 100 + 100]).coalesce(1).write.mode("append").parquet(f"{scratch.root}/events")
    return f"{scratch.root}/events", rows


def daily(spark, rows, before):
    out = {}
    for _, _, kind, s in rows:
        if (s // 86400 + 1) * 86400 <= before:
            out[s // 86400, kind] = out.get((s // 86400, kind), 0) + 1
    return out


def counted(df):
    return {((r.start.timestamp() - 1_704_067_200) // 86400, r.event_type): r.n for r in df.collect()}


def test_lateness_is_measured_and_no_row_is_lost(spark, shuffled):
    path, rows = shuffled
    late = streaming.lateness_seconds(spark, path)
    assert late == 299 * 600  # file 8 comes after file 10: from its first row to the last of that
    got = streaming.run_in_batches(spark, path, lambda e: streaming.tumbling_counts(e, "1 day"), "shuffled-test", 2)
    assert counted(got) == daily(spark, rows, rows[-1][3] - late - 1)


def test_a_run_that_breaks_off_goes_on_where_it_was(spark, shuffled, monkeypatch):
    path, rows = shuffled
    scratch, whole = Scratch(spark, "broken"), module.batch_sink
    run = lambda: streaming.run_in_batches(spark, path, lambda e: streaming.tumbling_counts(e, "1 day"), "broken", 3, scratch)
    done = []

    def breaking(out):
        write = whole(out)

        def put(df, batch):
            done.append(batch)
            if batch == 2:
                write(df.limit(1), batch)  # a part of the batch is there, and then the job dies
                raise RuntimeError("killed")
            write(df, batch)

        return put

    monkeypatch.setattr(module, "batch_sink", breaking)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(module, "batch_sink", lambda out: lambda df, batch: (done.append(batch), whole(out)(df, batch)))
    got = run()
    assert done.count(2) == 2 and done.count(0) == done.count(1) == 1 and max(done) > 2
    assert counted(got) == daily(spark, rows, rows[-1][3] - streaming.lateness_seconds(spark, path) - 1)
    assert counted(run()) == counted(got)  # nothing more to do, nothing twice


def test_deliveries_in_time(spark):
    scratch = Scratch(spark, "deliveries")
    rows = events_of(spark, [(i, 1, "a", i * 977 % 5000) for i in range(500)])
    streaming.deal_in_time(rows, f"{scratch.root}/t", 5)
    files = spark.read.parquet(f"{scratch.root}/t").select("event_id", "ts", F.col("_metadata.file_modification_time").alias("m"))
    assert sorted(r.event_id for r in files.collect()) == list(range(500)) and streaming.lateness_seconds(spark, f"{scratch.root}/t") <= 1000
    streaming.deal_in_time(rows.limit(0), f"{scratch.root}/none", 5)
    assert streaming.run_in_batches(spark, f"{scratch.root}/none", lambda e: streaming.tumbling_counts(e, "1 day"), "none", 2).count() == 0
