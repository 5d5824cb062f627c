"""Streams cut into triggers against their batches: sessions, sliding windows, carried state, late events, restarts."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from voltide.streaming import windows

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def rows(seed, n, kinds="ab", hours=200):
    r = random.Random(seed)
    return [(k, BEGIN + dt.timedelta(seconds=r.uniform(0, hours * 3600)), r.choice([1, 2, 3, None]), r.choice(kinds), r.uniform(1, 2)) for k in range(n)]



def files(spark, tmp_path, parts):
    """One file for each part, in the order of their times of writing."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for k, part in enumerate(parts, len(list(folder.iterdir()))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part-{k}")
        next((tmp_path / f"part-{k}").glob("*.parquet")).rename(folder / f"{k:03}.parquet")
    return str(folder)


def cut(events, n):
    events = sorted(events, key=lambda e: e[1])
    return [events[k * len(events) // n : (k + 1) * len(events) // n] for k in range(n)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("make", [windows.sessions, windows.sliding])
def test_triggers_give_the_batch(spark, tmp_path, make):
    events = rows(1, 900)
    folder = files(spark, tmp_path, cut(events, 4))
    mark = max(e[1] for e in events) - dt.timedelta(hours=1)
    whole = make(spark.read.parquet(folder))
    end = F.col("finish") if "finish" in whole.columns else F.col("start") + F.expr("INTERVAL 6 HOURS")
    got, want = collected(windows.through(spark, folder, make, "*.parquet")), collected(whole.where(end <= F.lit(mark).cast("timestamp")))
    assert len(want) > 100 and [r[:3] for r in got] == [r[:3] for r in want]
    assert all(a == pytest.approx(b) if isinstance(b, float) else a == b for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_a_late_event_joins_two_sessions_until_the_watermark_has_passed(spark, tmp_path):
    at = lambda minute: BEGIN + dt.timedelta(minutes=minute)
    first = [(1, at(0), 7, "a", 1.0), (2, at(50), 7, "a", 1.0), (3, at(60), 8, "b", 1.0)]
    second = [(4, at(25), 7, "b", 1.0), (5, at(600), 9, "a", 1.0)]
    third, fourth = [(6, at(700), 9, "a", 1.0)], [(7, at(20), 7, "b", 1.0), (8, at(900), 9, "a", 1.0)]  # the event at 20 is behind the watermark: dropped
    folder = files(spark, tmp_path, [first, second, third, fourth])
    got = {(r["user_id"], (r["start"] - BEGIN).seconds // 60, (r["finish"] - BEGIN).seconds // 60, r["n"]) for r in windows.through(spark, folder, windows.sessions, "*.parquet").collect()}
    assert got == {(7, 0, 80, 3), (8, 60, 90, 1), (9, 600, 630, 1), (9, 700, 730, 1)}


def plain(events, burn_in, window, expiry, mark):
    out = []
    for kind in {e[3] for e in events}:
        bars = {}
        for e in sorted((e for e in events if e[3] == kind), key=lambda e: (e[1], e[0])):
            bars[e[1].replace(minute=0, second=0, microsecond=0)] = e[4]
        before, series = None, []
        for start in sorted(b for b in bars if b + dt.timedelta(hours=1) <= mark):
            if before is None or start - before > dt.timedelta(hours=expiry):
                series = []
            else:
                r = bars[start] / bars[before] - 1
                series.append(r)
                v = g = None
                for k in range(len(series)):
                    v = statistics.variance(series[:burn_in]) if k == burn_in - 1 else None if v is None else 0.94 * v + 0.06 * series[k - 1] ** 2
                    g = sum(x * x for x in series[:window]) / window if k == window - 1 else None if g is None else max(0.01 + 0.08 * (series[k - 1] ** 2 - g) + 0.9 * g, 1e-12)
                out.append((kind, start, bars[start], r, v and math.sqrt(252 * v), g and math.sqrt(252 * g)))
            before = start
    return sorted(out, key=str)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9)) for g, w in zip(got, want, strict=True) for a, b in zip(g[3:], w[3:], strict=True))


def test_state_is_carried_over_triggers_and_restarts(spark, tmp_path):
    events = rows(3, 700) + rows(4, 60, "c", 400)  # c is sparse: its series begin anew
    events = [(k, *e[1:]) for k, e in enumerate(events)]
    run = lambda **o: collected(windows.recursive(spark, folder, "*.parquet", burn_in=5, window=12, expiry_hours=9, **o))
    parts = cut(events, 6)
    mark = max(e[1] for e in events) - dt.timedelta(hours=1)
    want = plain(events, 5, 12, 9, mark)
    folder = files(spark, tmp_path, parts[:3])
    out = str(tmp_path / "out")
    some = run(out=out)
    early = [e for p in parts[:3] for e in p]
    same(some, plain(early, 5, 12, 9, max(e[1] for e in early) - dt.timedelta(hours=1)))
    files(spark, tmp_path, parts[3:])
    same(run(out=out), want)  # a second run, from the checkpoint
    same(run(files=6), want)  # one trigger for all
    assert any(r[5] is not None for r in want) and len({r[0] for r in want}) == 3
