"""Ordered operations give the same rows whether or not a key is cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readtrace.operators.ordered import CHUNK, OrderedFrame, with_chunks
from readtrace.operators.quantiles import exact_quantiles

WHOLE_ROWS, CUT_ROWS = 10_000_000, 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, n in (("hot", 400), ("b", 30), ("c", 1)):
        for i in range(n):
            # Bursts and equal times, so that equal-width cuts are uneven.
            ts = int(rng.choice([rng.random() * 50, 500 + rng.random() * 3])) if key == "hot" else i
            data.append((key, ts, i, rng.choice([None, 1.0, 2.0, 5.5]), rng.randint(-3, 3)))
    return spark.createDataFrame(data, "k string, ts long, id long, v double, n int").cache()


def run(rows, target):
    f = OrderedFrame(rows, ["k"], ["ts", "id"], target_rows=target)
    f = (f.lag({"pv": "v", "pn": "n"}).running_sum("s", F.col("n")).running_min("m", F.col("n"))
         .row_number("rn").last_known("lk", F.col("v")).last_known("lb", F.col("v"), include_current=False)
         .trailing("t5", F.col("n"), 5))
    return f


def test_cut_equals_whole(rows):
    whole, cut = run(rows, WHOLE_ROWS), run(rows, CUT_ROWS)
    assert not whole.split and cut.split
    assert sorted(map(repr, whole.df.collect())) == sorted(map(repr, cut.df.collect()))


def test_plain_python(rows):
    got = {(r.k, r.id): r for r in run(rows, CUT_ROWS).df.collect()}
    for key in ("hot", "b", "c"):
        seen = sorted((r for r in rows.collect() if r.k == key), key=lambda r: (r.ts, r.id))
        total, known = 0, None
        for i, r in enumerate(seen):
            g = got[(key, r.id)]
            total += r.n
            assert g.lb == known
            known = r.v if r.v is not None else known
            assert (g.rn, g.s, g.lk) == (i + 1, total, known)
            assert g.m == min(x.n for x in seen[:i + 1])
            assert g.t5 == [x.n for x in seen[max(0, i - 4):i + 1]]
            assert (g.pv, g.pn) == ((seen[i - 1].v, seen[i - 1].n) if i else (None, None))


def test_chunks_cut_only_hot_keys_in_order(rows):
    df, split = with_chunks(rows, ["k"], ["ts"], CUT_ROWS)
    assert split
    spans = df.groupBy("k", CHUNK).agg(F.count("*").alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    assert {r[CHUNK] for r in spans if r.k != "hot"} == {-1}
    hot = sorted((r for r in spans if r.k == "hot"), key=lambda r: r[CHUNK])
    assert len(hot) > 2
    assert all(x.b < y.a for x, y in zip(hot, hot[1:]))


@pytest.mark.parametrize("target", [WHOLE_ROWS, CUT_ROWS])
def test_quantiles_match_numpy(rows, target):
    got = exact_quantiles(rows, ["k"], "ts", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, target).collect()
    for r in got:
        ts = [x.ts for x in rows.collect() if x.k == r.k]
        assert np.allclose([r.q1, r.q2, r.q3], np.percentile(ts, [25, 50, 75]))


def shapes():
    """One key each: an outlier far below, all rows at one position, bursts, and a key that is not hot."""
    data = [("outlier", 0 if i == 0 else 10 ** 15 + i, i) for i in range(1000)]
    data += [("one place", 77, i) for i in range(1000)]
    data += [("bursts", (i // 250) * 10 ** 9 + i % 7, i) for i in range(1000)]
    data += [("nulls", None if i % 3 else i, i) for i in range(1000)]
    return data + [("small", i, i) for i in range(30)]


@pytest.mark.parametrize("target", [40, 333])
def test_chunks_are_equally_deep(spark, target):
    df = spark.createDataFrame(shapes(), "k string, ts long, id long")
    cut, split = with_chunks(df, ["k"], ["ts", "id"], target)
    rows = cut.collect()
    assert split and {r[CHUNK] for r in rows if r.k == "small"} == {-1}
    for key in ("outlier", "one place", "bursts", "nulls"):
        mine = sorted(((r.ts is not None, r.ts or 0, r.id), r[CHUNK]) for r in rows if r.k == key)
        chunks = [c for _, c in mine]
        assert chunks == sorted(chunks) and len(set(chunks)) == -(-1000 // target)
        assert max(map(chunks.count, set(chunks))) <= 2 * target


def test_sampled_cuts_stay_below_twice_the_target(spark):
    df = spark.range(60_000).selectExpr("'hot' AS k", "id * id AS ts", "id")
    cut, _ = with_chunks(df, ["k"], ["ts", "id"], 2_000)  # 64 of 2 000 rows are looked at
    sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 4_000


def test_frames_within_another_are_not_measured(spark, monkeypatch):
    from readtrace.operators import keys, ordered
    times = []
    plain = ordered.cut_points
    monkeypatch.setattr(ordered, "cut_points", lambda *a, **k: times.append(1) or plain(*a, **k))
    rows = spark.createDataFrame([(1, i, i, "char", "a") for i in range(200)], "session_id long, ts_ns long, key_id long, kind string, char string")
    for target in (WHOLE_ROWS, 20):
        times.clear()
        keys.typed_words(keys.keystrokes(rows, ["session_id"], ["ts_ns", "key_id"], target_rows=target), ["session_id"], ["ts_ns", "key_id"]).collect()
        assert len(times) == 1


def test_keys_that_are_null_are_cut_too(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(300)], "k string, ts long, id long")
    cut, _ = with_chunks(df, ["k"], ["ts", "id"], 50)
    assert cut.select(CHUNK).distinct().count() == 6
