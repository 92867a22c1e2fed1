"""Failed lines, orphan references, heavy keys and sessions, against brute force and on awkward input."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import references as refs
from graphloom.operators import sessions, skew
from graphloom.sources import strict_load
from tests.conftest import rows

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def us(minutes):
    return int((T0 + timedelta(minutes=minutes)).timestamp() * 1e6)


# -- failed lines

GOOD = [
    "1\t2\t0.5\t2024-01-02 03:04:05", "-1\t-0\t-1.25E+1\t2024-02-29T23:59:59.123456Z", '"1"\t"2"\t"1e2"\t"2024-01-02 03:04:05.1+05:30"', "0000000000000000007\t2\t1\t2024-01-02 03:04:05 \r",
    "2147483647\t-2147483648\t2E-1\t2024-12-31 00:00:00-03:00\t", "1\t2\t1e308\t0001-01-01 00:00:00",
]
BAD = {
    "1\t2\t0.5": "columns", "1\t2\t0.5\t2024-01-02 03:04:05\t9": "columns", "(truncated)": "columns", "1 2 0.5 2024-01-02T03:04:05Z": "columns",
    '1\t2\t"0.5\t2024-01-02 03:04:05': "quoting", '1\t3"2\t0.5\t2024-01-02 03:04:05': "quoting", '1\t2\t0.5\t"2024-01-02 03:04:05"x': "quoting",
    '"1\t9"\t2\t0.5\t2024-01-02 03:04:05': "user_idx", "2147483648\t2\t0.5\t2024-01-02 03:04:05": "user_idx", "+1\t2\t0.5\t2024-01-02 03:04:05": "user_idx", "\t2\t0.5\t2024-01-02 03:04:05": "user_idx",
    "1\t2.0\t0.5\t2024-01-02 03:04:05": "item_idx", "1\t99999999999999999999999\t0.5\t2024-01-02 03:04:05": "item_idx", "1\t٣\t0.5\t2024-01-02 03:04:05": "item_idx",
    "1\t2\tNaN\t2024-01-02 03:04:05": "weight", "1\t2\t1e999\t2024-01-02 03:04:05": "weight", "1\t2\t1.\t2024-01-02 03:04:05": "weight", "1\t2\t.5\t2024-01-02 03:04:05": "weight", '1\t2\t"0""5"\t2024-01-02 03:04:05': "weight",
    "1\t2\t0.5\t2023-02-29 03:04:05": "inserted_at", "1\t2\t0.5\t2024-01-02 24:00:00": "inserted_at", "1\t2\t0.5\t2024-01-02 03:04:05.": "inserted_at", "1\t2\t0.5\t2024-01-02 03:04:05.1234567": "inserted_at",
    "1\t2\t0.5\t2024-01-02": "inserted_at", "1\t2\t0.5\t 2024-01-02 03:04:05": "inserted_at", "1\t2\t0.5\t0000-01-01 00:00:00": "inserted_at", "1\t2\t0.5\t2024-01-02 03:04:05z": "inserted_at", "1\t2\t0.5\t2024-01-02 03:04:05+24:00": "inserted_at",
}


def raw_lines(spark, lines, extra=False):
    data = [(k, "b", k + 2, line) for k, line in enumerate(lines)]
    df = spark.createDataFrame(data, "line_id bigint, batch string, line_no int, raw_line string")
    return df.withColumns({c: F.lit("?") for c in ("line", "parts", "conforms", "reason", "weight")}) if extra else df


@pytest.mark.parametrize("extra", [False, True])
def test_lines_are_loaded_or_rejected_with_a_reason(spark, extra):
    lines = [*GOOD, *BAD, "", " \t\r", None, "x" * 200_000]
    raw = raw_lines(spark, lines, extra)
    assert rows(strict_load.strict_load(raw), "line_id") == [(k,) for k in range(len(GOOD))]
    got = {r["line_id"]: r["reason"] for r in strict_load.rejects(raw).collect()}
    assert got == {len(GOOD) + k: reason for k, reason in enumerate([*BAD.values()])} | {len(lines) - 1: "columns"}


def test_typed_values(spark):
    got = {r["line_id"]: r for r in strict_load.strict_load(raw_lines(spark, GOOD)).withColumn("us", F.unix_micros("inserted_at")).drop("inserted_at").collect()}
    micros = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)
    assert got[1]["us"] == micros(2024, 2, 29, 23, 59, 59) + 123456 and got[1]["weight"] == -12.5 and got[1]["item_idx"] == 0
    assert got[2]["us"] == micros(2024, 1, 1, 21, 34, 5) + 100000 and got[2]["user_idx"] == 1
    assert got[3]["user_idx"] == 7 and got[4]["us"] == micros(2024, 12, 31, 3) and got[4]["user_idx"] == 2**31 - 1


def test_header_lines_and_empty_tables(spark):
    raw = raw_lines(spark, ["user_idx\titem_idx\tweight\tinserted_at"]).withColumn("line_no", F.lit(1))
    assert strict_load.rejects(raw).count() == strict_load.strict_load(raw).count() == 0
    assert strict_load.rejects(raw.limit(0)).count() == 0


# -- orphan references


def make_refs(spark, data, targets):
    r = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(data)], "id bigint, key bigint, t timestamp").withColumn("space", F.lit("clash"))
    t = spark.createDataFrame([(k, at(b), at(d)) for k, b, d in targets], "key bigint, born timestamp, died timestamp").withColumn("at_us", F.lit(0))
    pointing = [refs.references("f", r, F.col("id"), F.lit("t"), F.col("key"), F.col("t"))]
    return pointing, [refs.records("t", t, F.col("key"), F.col("born"), F.col("died"))]


def brute_orphans(data, targets):
    out = []
    for i, (k, t) in enumerate(data):
        if k is None:
            continue
        mine = [x for x in targets if x[0] == k]
        dead = lambda b, d: t is not None and (b is not None and t < b or d is not None and t >= d)
        if not mine or all(dead(b, d) for _, b, d in mine):
            out.append(i)
    return out


@pytest.mark.parametrize("salt_rows", [5, 60, 1_000])
def test_orphans_match_brute_force(spark, salt_rows):
    rng = random.Random(5)
    some = lambda p, hi: None if rng.random() < p else rng.randrange(hi)
    targets = [(k, some(0.3, 50), some(0.6, 100)) for k in range(20) if k % 4] * 2
    data = [(3 if rng.random() < 0.3 else some(0.1, 25), some(0.1, 120)) for _ in range(400)]
    pointing, tables = make_refs(spark, data, targets)
    assert rows(refs.orphan_rows(pointing, tables, salt_rows), "row_id") == [(i,) for i in brute_orphans(data, targets)]


def test_orphan_boundaries_and_empty_tables(spark):
    data = [(1, 10), (1, 9), (1, 20), (1, 19), (2, None), (3, None), (None, 5)]
    pointing, tables = make_refs(spark, data, [(1, 10, 20), (2, 10, 5)])
    assert rows(refs.orphan_rows(pointing, tables), "row_id") == [(1,), (2,), (5,)]
    report = refs.orphan_report(refs.orphan_rows(pointing, tables), tables)
    assert rows(report, "reason", "period", "n") == [("early", "2024-01", 1), ("gone", "2024-01", 1), ("missing", "unknown", 1)]
    pointing, none = make_refs(spark, data, [])
    assert refs.orphan_rows(pointing, none).count() == 6
    nothing, tables = make_refs(spark, [], [(1, 1, None)])
    assert refs.orphan_rows(nothing, tables).count() == 0


def test_ledger_in_batches_equals_at_once(spark, tmp_path):
    """Three stored batches, the second applied twice, hold what one batch holds; rows that are withdrawn leave it."""
    rng = random.Random(6)
    minutes = 60 * 24 * 90
    data = [(rng.choice([None, *range(12)]), rng.choice([None, rng.randrange(minutes)])) for _ in range(300)]
    targets = [(k, rng.choice([None, rng.randrange(minutes)]), rng.choice([None, rng.randrange(minutes)])) for k in range(8)]
    pointing, tables = make_refs(spark, data, targets)
    r, e = refs.reference_deltas(pointing), refs.existence_deltas(refs.united(tables))
    whole = refs.Ledger(spark, f"file://{tmp_path}/whole").apply(0, r, e)
    stored = refs.Ledger(spark, f"file://{tmp_path}/batches")
    low, high = us(minutes // 3), us(minutes // 2)
    parts = [lambda d: d.where(F.col("at_us").isNull() | (F.col("at_us") < low)), lambda d: d.where(F.col("at_us").between(low, high)), lambda d: d.where(F.col("at_us") > high)]
    for batch in (0, 1, 1, 2):
        stored.apply(batch, parts[batch](r), parts[batch](e))
    assert rows(stored.rows()) == rows(whole.rows())
    assert rows(stored.current_orphans()) == rows(whole.current_orphans())
    assert rows(refs.orphan_rows(pointing, tables, 20, stored), "row_id") == [(i,) for i in brute_orphans(data, targets)]
    gone = {k for k, _ in data if k is not None} - {k for k, b, d in targets if d is None}
    assert {x["key"] for x in stored.current_orphans().collect()} == gone
    stored.apply(3, refs.reference_deltas(pointing, -1))
    assert stored.current_orphans().count() == 0 and refs.orphan_stretches(stored.rows()).count() == 0


# -- heavy keys


def test_heavy_keys_are_exact(spark):
    keys = [1] * 40 + [2] * 20 + [None] * 20 + list(range(100, 120))
    df = spark.createDataFrame([(k, 1) for k in keys], "k int, rows int")
    assert rows(skew.heavy_keys(df, "k", 0.2), "k", "rows", "total") == [(1, 40, 100), (2, 20, 100)]
    assert rows(skew.heavy_keys(df, "k", 0.21), "k") == [(1,)]
    assert skew.heavy_keys(df.limit(0), "k", 0.2).count() == 0
    assert skew.heavy_keys(df.where("k is null"), "k", 0.2).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "k", 0.0)


@pytest.mark.parametrize("share", [0.01, 0.3])
def test_per_key_stats_match_brute_force(spark, share):
    rng = random.Random(7)
    data = [(7 if rng.random() < 0.4 else rng.choice([None, *range(30)]), rng.choice([None, *range(9)]), rng.choice([None, 0.5, 1.25, -2.0, float("nan"), 1e30])) for _ in range(600)]
    data += data[:50]
    df = spark.createDataFrame(data, "k int, m int, v float").withColumns({c: F.lit(1) for c in ("salt", "t", "rows", "members", "total")})
    expected = []
    for k in sorted({d[0] for d in data} - {None}):
        mine = [d for d in data if d[0] == k]
        values = [v for _, _, v in mine if v is not None and v == v and abs(v) < 1e20]
        expected.append((k, len(mine), len({m for _, m, _ in mine if m is not None}), sum(values) if values else None))
    assert rows(skew.per_key_stats(df.withColumn("x", F.col("v")).drop("v").withColumnRenamed("x", "v"), "k", "m", "v", share)) == expected
    assert skew.per_key_stats(df.limit(0), "k", "m", "v").count() == 0


# -- sessions


def brute_sessions(events, gap):
    out = []
    for u in sorted({u for u, t in events if u is not None and t is not None}):
        times = sorted(t for v, t in events if v == u and t is not None)
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((u, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last, last - start, n))
    return out


def test_sessions_match_brute_force(spark):
    rng = random.Random(8)
    events = [(1 if rng.random() < 0.4 else rng.choice([None, 2, 3]), rng.choice([None, rng.randrange(-3_000, 3_000)])) for _ in range(500)]
    events += [(9, 0), (9, 30), (9, 60), (9, 91), (9, 0), (8, -45), (8, -15), (8, 15)]
    df = spark.createDataFrame([(u, at(t)) for u, t in events], "u int, t timestamp").withColumns({c: F.lit(0) for c in ("k", "us", "slot", "n", "session")})
    minute = 60_000_000
    base = us(0)
    expected = [(u, base + s * minute, base + e * minute, d * minute, n) for u, s, e, d, n in brute_sessions(events, 30)]
    assert rows(sessions.sessionize(df, "u", "t", 1800)) == expected
    assert sessions.sessionize(df.limit(0), "u", "t").count() == 0
    with pytest.raises(ValueError):
        sessions.sessionize(df, "u", "t", 0)
