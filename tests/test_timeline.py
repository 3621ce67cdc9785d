"""Overlaps against a literal walk over each day, small days and crowded ones."""

import random

import pytest

from wayledger.operators import quality, timeline
from wayledger.session import HOT_ROWS

ITEM = "id long, trip_id long, day_number int, start_time string, duration_minutes int"


def day(chance, trip, count, lengths):
    return [
        (trip * 1000 + i, trip, 1, f"{8 + chance.randrange(3)}:{chance.randrange(4) * 15:02d}", chance.choice(lengths))
        for i in range(count)
    ]


@pytest.fixture(scope="module")
def data():
    chance = random.Random(11)
    rows = []
    for trip in range(1, 30):
        rows += day(chance, trip, chance.randrange(1, 9), [None, 0, 15, 30, 60])
    rows += day(chance, 90, 60, [None, 0, 15, 45, 90])
    rows += [(1, 95, 1, None, 30), (2, 95, None, "08:00", 30), (3, 95, 1, "late", 30), (4, 95, 1, "25:10", 30)]
    return rows


def minutes(text):
    hours, rest = text.split(":")
    return int(hours) * 60 + int(rest)


def overlap(a, b):
    return a[0] < b[1] and b[0] < a[1]


def walk(data):
    """(cluster, column, columns, overlaps) per item, by trying one item after the other."""
    days, out = {}, {}
    for id_, trip, number, start, length in data:
        if number is not None and start and start.replace(":", "").isdigit():
            days.setdefault((trip, number), []).append((minutes(start), minutes(start) + (length or 0), id_))
    for items in days.values():
        items.sort(key=lambda x: (x[0], x[2]))
        cluster, reach, groups = 0, None, []
        for item in items:
            if reach is None or item[0] >= reach:
                groups.append([])
            groups[-1].append(item)
            reach = item[1] if reach is None else max(reach, item[1])
        for cluster, group in enumerate(groups, 1):
            columns = []
            for item in group:
                free = [i for i, c in enumerate(columns) if not any(overlap(o, item) for o in c)]
                at = free[0] if free else len(columns)
                columns += [[]] if not free else []
                columns[at].append(item)
                overlaps = sum(o[2] != item[2] and overlap(o, item) for o in items)
                out[item[2]] = [cluster, at, None, overlaps]
            for item in group:
                out[item[2]][2] = len(columns)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("hot_rows", [None, "3", "25"])
def test_columns_and_conflicts_match_the_walk(spark, data, hot_rows):
    items = spark.createDataFrame(data, ITEM)
    if hot_rows:
        spark.conf.set(HOT_ROWS, hot_rows)
    try:
        columns = timeline.timeline_columns(items).collect()
        conflicts = {r.id: r.conflict for r in timeline.conflict_flags(items).collect()}
        counts = {r.id: r.overlaps for r in timeline.overlap_counts(items).collect()}
        pairs = {r.id: r.partner_id for r in timeline.overlap_pairs(items).collect()}
    finally:
        spark.conf.unset(HOT_ROWS)
    want = walk(data)
    assert {r.id: (r.cluster, r.col, r.cols, counts[r.id]) for r in columns} == want
    assert conflicts == {k: v[3] > 0 for k, v in want.items()}
    assert set(pairs) == {k for k, v in want.items() if v[3]}
    spans = {d[0]: (minutes(d[3]), minutes(d[3]) + (d[4] or 0)) for d in data if d[0] in want}
    assert all(overlap(spans[a], spans[b]) and a != b for a, b in pairs.items())


@pytest.mark.parametrize("pack_rows", [1, 4])
def test_columns_packed_in_groups(spark, data, monkeypatch, pack_rows):
    """Clusters over the size of the small ones, below the hot-key limit."""
    monkeypatch.setattr(timeline, "PACK_ROWS", pack_rows)
    columns = timeline.timeline_columns(spark.createDataFrame(data, ITEM)).collect()
    want = walk(data)
    assert {r.id: (r.cluster, r.col, r.cols) for r in columns} == {k: v[:3] for k, v in want.items()}


def test_a_day_of_all_minutes_takes_few_jobs(spark):
    """One cluster over every minute of a day, far beyond the hot-key limit, and one that begins later."""
    chance, rows = random.Random(4), []
    for minute in range(1440):
        for k in range(3):
            start = f"{minute // 60:02d}:{minute % 60:02d}"
            rows.append((minute * 10 + k, 1, 1, start, chance.choice([0, 1, 5, 30]) if k else 2))
            if minute > 700 and k == 0:
                rows.append((10**6 + minute, 2, 1, start, 3))
    items = spark.createDataFrame(rows, ITEM)
    spark.conf.set(HOT_ROWS, "100")
    spark.sparkContext.setJobGroup("columns of a long day", "")
    try:
        columns = timeline.timeline_columns(items).collect()
    finally:
        spark.conf.unset(HOT_ROWS)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("columns of a long day")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.id: (r.cluster, r.col, r.cols) for r in columns} == {k: v[:3] for k, v in walk(rows).items()}
    assert len(jobs) <= 200


def test_spans():
    assert timeline.spans_of([(1, 5), (2, 4), (3, 1), (9, 11), (10, 3), (11, 7)], 10) == [[1, 2, 3], [9], [10, 11]]
    assert timeline.spans_of([], 10) == []


def test_negative_lengths_take_no_part(spark):
    items = spark.createDataFrame([(1, 1, 1, "09:00", 30), (2, 1, 1, "09:20", -60), (3, 1, 1, "09:25", 10)], ITEM)
    assert {r.id: r.conflict for r in timeline.conflict_flags(items).collect()} == {1: True, 3: True}
    assert {r.id: r.overlaps for r in timeline.overlap_counts(items).collect()} == {1: 1, 3: 1}
    assert {(r.id, r.partner_id) for r in timeline.overlap_pairs(items).collect()} == {(1, 3), (3, 1)}
    assert {r.id for r in timeline.timeline_columns(items).collect()} == {1, 3}
    assert [r.id for r in quality.find(items, quality.bad_duration()).collect()] == [2]


def test_same_minute_conflicts_only_when_both_last(spark):
    items = spark.createDataFrame(
        [(1, 1, 1, "09:00", 0), (2, 1, 1, "09:00", 30), (3, 2, 1, "09:00", 10), (4, 2, 1, "09:00", 30)], ITEM
    )
    flags = {r.id: r.conflict for r in timeline.conflict_flags(items).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True}
