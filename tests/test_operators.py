from tessera.operators import asof_join, interval_join, not_in, salted_join, sessions, top_k_per_group
from tessera.plans import catalog


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 1), (2, 7), (None, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 10, "b"), (1, 10, "c"), (3, 1, "x"), (None, 4, "n")], "k int, rt int, v string")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {(1, 5): "a", (1, 10): "c", (1, 1): None, (2, 7): None, (None, 4): "n"}


def test_interval_join_bounds(spark):
    points = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (25.0,), (-3.0,), (None,)], "p double")
    spans = spark.createDataFrame([(0.0, 10.0), (-5.0, 30.0), (10.0, 10.0), (None, 3.0)], "a double, b double")
    got = sorted((r.p, r.a) for r in interval_join(points, spans, "p", "a", "b", 4.0).collect())
    assert got == sorted((p, a) for p in (0.0, 9.9, 10.0, 25.0, -3.0) for a, b in ((0.0, 10.0), (-5.0, 30.0)) if a <= p < b)


def test_not_in_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = lambda rows: spark.createDataFrame([(r,) for r in rows], "y int")
    values = lambda rows: sorted((r.x for r in not_in(left, "x", right(rows), "y").collect()), key=str)
    assert values([1]) == [2] and values([1, None]) == [] and values([]) == [1, 2, None]


def test_salted_join_is_the_plain_join(spark):
    facts = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k int, v int")
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, n string")
    assert sorted(map(tuple, salted_join(facts, keys, "k", 4).collect())) == sorted(map(tuple, facts.join(keys, "k").collect()))


def test_sessions_and_top_k(spark):
    rows = spark.sql("select 1 as u, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) as ts from values (0), (9), (19), (28) as t(m)")
    assert [(r.session, r.n_events) for r in sessions(rows, ["u"], "ts", 600).orderBy("session").collect()] == [(1, 2), (2, 2)]
    best = top_k_per_group(spark.createDataFrame([(1, 3), (1, 5), (2, 1), (1, 4)], "g int, v int"), ["g"], [catalog.F.desc("v")], 2)
    assert sorted((r.g, r.v, r["rank"]) for r in best.collect()) == [(1, 4, 2), (1, 5, 1), (2, 1, 1)]


def test_closed_stream_windows_are_the_batch_ones(spark):
    sf = "/root/testdata/sf0.001"
    batch = {(r.start, r.event_type): r.n for r in spark.sql("select date_trunc('day', ts)::timestamp_ntz as start, event_type, count(*) as n from {e} group by 1, 2", e=spark.read.parquet(f"{sf}/events.parquet")).collect()}
    stream = {(r.start, r.event_type): r.n for r in catalog.QUERIES["stream_tumbling"](spark, sf).collect()}
    last = max(batch)[0]
    assert stream == {k: v for k, v in batch.items() if k[0] < last}
    assert 0 < catalog.QUERIES["stream_sessions"](spark, sf).count() <= catalog.QUERIES["time_sessions"](spark, sf).count()


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark):
    from tessera import streaming

    rows = lambda *at: spark.sql("select 1L as event_id, 1L as user_id, 'a' as event_type, 1.0D as value, cast(t as timestamp_ntz) as ts from values " + ", ".join(f"('2024-01-{x}')" for x in at) + " as v(t)")
    deliveries = [rows("01 05:00:00", "05 12:00:00"), rows("01 06:00:00", "04 01:00:00", "05 13:00:00"), rows("01 07:00:00", "09 00:00:00")]
    got = streaming.run_deliveries(spark, deliveries, lambda e: streaming.tumbling_counts(e, "1 day"), "late-test", "1 day")
    # Rows of the 1st that come with later deliveries are too late; that of the 4th is not.
    assert sorted((r.start.day, r.n) for r in got.collect()) == [(1, 1), (4, 1), (5, 2)]


def test_words_of_awkward_texts(spark):
    from tessera.functions import words

    df = spark.createDataFrame([(1, " a  b "), (2, None), (3, ""), (4, "c")], "id long, text string")
    assert sorted(map(tuple, words(df).collect())) == [(1, "a", 0), (1, "b", 1), (4, "c", 0)]
    assert words(df.limit(0)).count() == 0
