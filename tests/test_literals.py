"""Small literal cases for expressions, plans, exports, replies, checks and changes."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wayledger.functions import clock, money, text
from wayledger.operators import changes, exports, itinerary, planning, quality, replies, shopping
from wayledger.schemas import schema
from wayledger.sources.tables import append_log, fill_defaults, read_table, write_snapshot


def values(spark, expression, data, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, c {kind}")
    return [r.x for r in df.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def test_time_expressions(spark):
    assert values(spark, clock.time_to_minutes, ["00:00", "09:30", "23:59", "9:05", "abc", "", None, "12:5"]) == [
        0, 570, 1439, 545, None, None, None, None,
    ]
    assert values(spark, clock.minutes_to_time, [0, 570, 99999, -10, None], "int") == [
        "00:00", "09:30", "23:59", "00:00", None,
    ]
    assert values(spark, lambda c: clock.shift_time(c, F.lit(-60)), ["12:00", "00:30"]) == ["11:00", "00:00"]
    assert values(spark, lambda c: clock.end_time(c, F.lit(90)), ["09:00", "23:00"]) == ["10:30", "23:59"]


def test_time_grammars_stay_apart(spark):
    given = ["09:30", "9:30", "24:00", "25:99", "10:00:00", " 09:30 ", "abc", "12:60"]
    want = {
        "page": [1, 0, 0, 0, 0, 1, 0, 0],
        "strict": [1, 0, 0, 0, 0, 1, 0, 0],
        "suggestion": [1, 1, 0, 0, 0, 0, 0, 0],
        "lax": [1, 1, 1, 1, 0, 0, 0, 1],
        "export": [1, 1, 1, 1, 1, 0, 0, 1],
    }
    for grammar, flags in want.items():
        assert values(spark, lambda c, g=grammar: clock.valid_time(c, g), given) == [bool(f) for f in flags], grammar


def test_text_expressions(spark):
    assert values(spark, text.js_trim, ["　 a b ﻿", "\t\n", None]) == ["a b", "", None]
    assert values(spark, text.js_parse_int, ["3 days", " -4", "x", "", "2.9", None]) == [3, -4, None, None, 2, None]
    assert values(spark, text.ics_escape, ["a;b,c\\d\ne\r\nf"]) == ["a\\;b\\,c\\\\d\\ne\\nf"]
    assert values(spark, text.csv_escape, ['a"b', "a,b", "plain", None]) == ['"a""b"', '"a,b"', "plain", ""]
    assert values(spark, text.component_encode, ["a b!'()*~é/"]) == ["a%20b!'()*~%C3%A9%2F"]
    assert values(spark, text.form_encode, ["a b~*"]) == ["a+b%7E*"]
    assert values(spark, lambda c: money.money_text(c.cast("decimal(12,2)")), ["2.50", "3.50", "1234567.40", None]) == [
        "NT$ 3", "NT$ 4", "NT$ 1,234,567", "NT$ 0",
    ]


PLAN_ITEM = "id long, trip_id long, day_number int, start_time string, duration_minutes int, sort_order int"
REQUEST = "trip_id long, day_number int, ids array<long>"


def reorder(spark, items, ids):
    table = spark.createDataFrame([(i, 1, 1, t, d, n) for n, (i, t, d) in enumerate(items)], PLAN_ITEM)
    asked = planning.request_rows(spark.createDataFrame([(1, 1, ids)], REQUEST))
    rows = planning.reorder_plan(table, asked).collect()
    return {r.id: (r.start_time, r.sort_order) for r in rows}


def test_reorder(spark):
    day = [(1, "09:00", 60), (2, "10:00", 30), (3, "11:00", 90)]
    assert reorder(spark, day, [3, 1, 2]) == {3: ("09:00", 0), 1: ("10:30", 1), 2: ("11:30", 2)}
    untimed = [(1, "09:00", 60), (2, None, 30), (3, "11:00", 90)]
    assert reorder(spark, untimed, [1, 2, 3]) == {1: ("09:00", 0), 3: ("10:00", 2)}
    assert reorder(spark, [(1, None, 60)], [1]) == {}
    assert reorder(spark, day, [3, 99, 2]) == {3: ("09:00", 0), 2: ("10:30", 2)}
    # a repeated id: the last mention counts, both move what follows
    assert reorder(spark, day, [1, 2, 1, 3]) == {2: ("10:00", 1), 1: ("10:30", 2), 3: ("11:30", 3)}
    # the day's earliest time counts although its item is not asked for; no length is zero
    assert reorder(spark, [(1, "08:00", None), (2, "10:00", None), (3, "23:50", 60)], [2, 3]) == {
        2: ("08:00", 0), 3: ("08:00", 1),
    }


def cascade(spark, items, target, new_time, picks):
    table = spark.createDataFrame([(i, 1, 1, t, 60, 0) for i, t in items], PLAN_ITEM)
    request = spark.createDataFrame([(5, 1, target, new_time)], "request_id long, trip_id long, target_id long, new_time string")
    chosen = spark.createDataFrame([(5, p) for p in picks], "request_id long, item_id long")
    rows = planning.cascade_plan(table, request, chosen).collect()
    return {r.id: (r.start_time, r.delta_minutes, r.error) for r in rows}


def test_cascade(spark):
    day = [(1, "09:00"), (2, "10:00"), (3, "11:00")]
    assert cascade(spark, day, 1, "10:00", [2, 3]) == {
        1: ("10:00", 60, None), 2: ("11:00", 60, None), 3: ("12:00", 60, None),
    }
    assert cascade(spark, [(1, "09:00"), (2, None)], 1, "08:00", [2, 77, 1]) == {1: ("08:00", -60, None)}
    assert cascade(spark, [(1, None)], 1, "10:00", [1]) == {None: (None, None, "untimed_target")}
    assert cascade(spark, day, 9, "10:00", [2]) == {None: (None, None, "unknown_target")}
    for unreadable in ("noon", "25:99", None, ""):
        assert cascade(spark, day, 1, unreadable, [2]) == {None: (None, None, "bad_time")}


def test_several_changes_of_one_row(spark):
    """Each change starts from the state that the last one left, and the table keeps its rows."""
    items = spark.createDataFrame([(1, 1, 1, "09:00", 60, 0), (2, 1, 1, "10:00", 60, 1), (3, 1, None, None, 60, 0)], PLAN_ITEM)
    items = items.withColumn("is_confirmed", F.lit(False))
    cols = "item_id long, at int, day_number int, start_time string, is_confirmed boolean, clear array<string>"
    back = ["day_number", "start_time"]
    patches = spark.createDataFrame(
        [
            (1, 1, None, None, None, back), (1, 2, None, None, True, []),
            (2, 1, 2, "11:00", None, []), (2, 2, None, None, None, back), (2, 3, None, "12:00", None, None),
            (3, 2, None, None, None, ["start_time"]), (3, 1, 1, "08:00", True, []), (3, 3, None, None, None, ["duration_minutes"]),
        ],
        cols,
    )
    rows = changes.patch_items(items, patches, "at").collect()
    after = {r.id: (r.day_number, r.start_time, r.is_confirmed, r.duration_minutes) for r in rows}
    assert len(rows) == 3
    assert after == {1: (None, None, True, 60), 2: (None, "12:00", False, 60), 3: (1, None, True, None)}
    twice = patches.select("item_id", "is_confirmed").where("item_id = 1")
    assert changes.set_flags(items, twice.unionByName(twice)).count() == 3
    ids = items.select("id").where("id < 3")
    assert changes.unschedule_items(items.drop("is_confirmed"), ids.unionByName(ids)).count() == 3


def test_requests_keep_their_order(spark):
    items = spark.createDataFrame([(i, 1, None, None, 60, 0) for i in (1, 2)] + [(3, 1, 1, "09:00", 60, 4)], PLAN_ITEM)
    asked = spark.createDataFrame(
        [(2, 1, 1, "10:00"), (1, 2, 1, "11:00"), (2, 3, 1, "12:00"), (1, 0, 2, "01:00")],
        "item_id long, at int, day_number int, start_time string",
    )
    rows = {r.id: (r.day_number, r.start_time, r.sort_order) for r in changes.schedule_items(items, asked, "at").collect()}
    assert rows == {1: (1, "11:00", 5), 2: (1, "12:00", 6), 3: (1, "09:00", 4)}
    budget = spark.createDataFrame([(1, Decimal(5), "2026-01")], "list_id long, monthly_budget decimal(12,2), last_cleared string")
    asked = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 2, 4), (2, 1, 9)], "list_id long, at int, monthly_budget int")
    stored = {r.list_id: r.monthly_budget for r in changes.upsert_budget(budget, asked, "at").collect()}
    assert stored == {1: 8, 2: 4} and changes.upsert_budget(budget, asked.drop("at")).count() == 2


def test_cascades_and_single_moves_are_applied_and_logged(spark):
    items = spark.createDataFrame([(i, 1, 1, f"{8 + i:02d}:00", 60, i) for i in (1, 2, 3)], PLAN_ITEM)
    requests = spark.createDataFrame([(5, 1, 2, "11:00")], "request_id long, trip_id long, target_id long, new_time string")
    picks = spark.createDataFrame([(5, 3), (5, 2)], "request_id long, item_id long")
    plan = planning.cascade_plan(items, requests, picks)
    after, log = changes.apply_plans(items, changes.cascade_updates(items, plan))
    assert {r.id: (r.start_time, r.sort_order) for r in after.collect()} == {1: ("09:00", 1), 2: ("11:00", 2), 3: ("12:00", 3)}
    entry = log.first()
    assert entry.instruction == changes.ADJUSTED
    assert [(c.id, c.start_time) for c in entry.items_changed] == [(2, "11:00"), (3, "12:00")]
    moves = spark.createDataFrame([(1, 1, "10:15"), (2, 2, "noon"), (3, 1, "9:40")], "request_id long, item_id long, new_time string")
    after, log = changes.apply_plans(items, changes.cascade_updates(items, planning.single_plan(moves)))
    assert {r.id: r.start_time for r in after.collect()} == {1: "9:40", 2: "10:00", 3: "11:00"}
    assert log.count() == 1


TRIP = "id long, username string, name string, start_date date, end_date date"
EXPORT_ITEM = (
    "id long, trip_id long, day_number int, name string, start_time string, duration_minutes int, location string, "
    "notes string, booking_ref string, confirm_required boolean, is_confirmed boolean"
)


@pytest.fixture
def export_tables(spark):
    trips = spark.createDataFrame(
        [(7, "u", "Island, four days", datetime.date(2026, 9, 1), datetime.date(2026, 9, 4))], TRIP
    )
    items = [
        (1, 7, 1, "Aquarium", "10:00", 120, "Big tank", "tickets first", "", False, False),
        (2, 7, 1, "Tavern, first", "18:30", None, "Main street", 'desk says "six"', "R-2211", False, False),
        (3, 7, 3, "Cape", None, 45, "Cape west", "", "", False, False),
        (4, 7, 2, "Hotel rest", "23:30", 90, " ", "no place", "", False, False),
        (5, 7, None, "Village", None, None, "Old village", "maybe", "", False, False),
    ]
    return trips, spark.createDataFrame(items, EXPORT_ITEM)


def test_calendar_export(spark, export_tables):
    trips, items = export_tables
    stamps = {r.id: (r.start_stamp, r.end_stamp) for r in exports.ics_events(trips, items).collect()}
    assert stamps == {
        1: ("20260901T100000", "20260901T120000"),
        2: ("20260901T183000", "20260901T193000"),
        3: ("20260903T090000", "20260903T094500"),
        4: ("20260902T233000", "20260903T010000"),
    }
    made = exports.ics_documents(trips, items, datetime.datetime(2026, 8, 16, 3, 0, 0)).collect()
    document = made[0].document
    assert len(made) == 1 and document.count("BEGIN:VEVENT") == 4 and "Village" not in document
    assert document.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n") and document.endswith("END:VCALENDAR\r\n")
    assert "X-WR-CALNAME:Island\\, four days\r\n" in document and "DTSTAMP:20260816T030000Z" in document
    assert "DESCRIPTION:預約編號：R-2211\\ndesk says" in document
    assert document.count("LOCATION:") == 4  # a place of blanks is still written
    late = items.where("id = 1").withColumn("start_time", F.lit("25:15:00"))
    rolled = exports.ics_events(trips, late).first()
    assert (rolled.start_stamp, rolled.end_stamp) == ("20260902T011500", "20260902T031500")


def test_map_export_and_links(spark, export_tables):
    trips, items = export_tables
    document = exports.maps_csv_documents(items).first().document
    lines = document.split("\r\n")
    assert lines[0] == "name,location,day,time,notes" and len(lines) == 6 and lines[-1] == ""
    assert '"Tavern, first",Main street,1,18:30,"desk says ""six"""' in lines
    assert "Village,Old village,,,maybe" in lines
    links = {r.id: r.link for r in exports.calendar_links(trips, items).collect()}
    assert set(links) == {1, 2, 3, 4}
    assert links[2].startswith(
        "https://calendar.google.com/calendar/render?action=TEMPLATE&text=Tavern%2C+first&dates=20260901T183000%2F2026"
    )
    assert {r.id for r in exports.map_links(items).collect()} == {1, 2, 3, 5}


BUY = (
    "id long, list_id long, name string, price decimal(12,2), urgency string, bought boolean, quantity int, "
    "category string, tag string, note string, link string, created_at timestamp"
)


def test_share(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [
        (1, 1, "a", Decimal(800), "want", False, 1, "", "gift", "", "", at),
        (2, 1, "b", Decimal(1200), "need", False, 1, "", "gift", "", "", at),
        (3, 1, "c", Decimal(9), "need", True, 1, "", "gift", "", "", at),
        (4, 1, "d", Decimal(9), "need", False, 1, "", " gift ", "", "", at),
    ]
    buylist = spark.createDataFrame(rows, BUY)
    asked = spark.createDataFrame([(1, " gift "), (1, ""), (1, "x" * 61), (1, "gone")], "list_id long, tag string")
    shared = exports.public_share(buylist, asked).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.urgency_label) for r in shared] == [(2, 1, "很想要"), (1, 2, "想要")]
    assert set(shared[0].asDict()) == {*exports.PUBLIC_FIELDS, "list_id", "urgency_label", "rank"}
    texts = {r.tag: r.document for r in exports.share_json(buylist, asked).collect()}
    assert texts["gone"] == '{"tag":"gone","count":0,"items":[]}'
    assert texts["gift"].startswith('{"tag":"gift","count":2,"items":[{"id":2,"name":"b","price":1200.00')
    assert {r.tag for r in quality.find(asked, quality.bad_tag_request()).collect()} == {"", "x" * 61}


def test_reply_status(spark):
    good = '[{"day":1,"name":"A"}]'
    given = {
        good: "ok",
        f"```json\n{good}\n```": "ok",
        f"Here you are:\n{good}": "ok",
        "": "empty",
        " 　": "empty",
        '{"day":1}': "not_array",
        "5": "not_array",
        "null": "not_array",
        "no json at all": "unparsable",
        "] then [": "unparsable",
        "```": "unparsable",
        "[1] tail": "ok",
        "{'a': 1}": "unparsable",
        "[1, ]": "unparsable",
        "[]": "empty_array",
        '["a"]': "ok",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "reply_id int, raw string")
    got = {r.raw: r.status for r in replies.reply_status(df).collect()}
    assert got == given


def test_reply_elements_keep_untyped_values(spark):
    raw = '[{"name": 5, "day": 2.5, "duration_minutes": "90"}, {"day": null}, 7]'
    df = spark.createDataFrame([(1, raw)], "reply_id int, raw string")
    rows = replies.reply_elements(df).orderBy("pos").collect()
    assert [(r.name, r.day, r.duration_minutes) for r in rows] == [("5", "2.5", "90"), (None, None, None), (None, None, None)]


ELEMENT = "reply_id long, trip_id long, pos int, name string, day string, start_time string, duration_minutes string, category string, location string"


def test_suggestions(spark):
    trips = spark.createDataFrame([(1, "u", "t", datetime.date(2026, 9, 1), datetime.date(2026, 9, 4))], TRIP)
    cases = [
        ("X", None, None, None, None), ("X", "9", "25:00", "0", "food"), ("X", "0", "9:30", "90", "RESTAURANT"),
        ("X", "3", "早上", "-5", " Hotel "), ("  ", "1", "09:00", "60", "other"),
    ]
    rows = [(1, 1, i, n, d, t, m, c, "") for i, (n, d, t, m, c) in enumerate(cases)] + [
        (2, 99, 0, "Y", "5", None, None, None, " there ")
    ]
    made = replies.suggested_items(spark.createDataFrame(rows, ELEMENT), trips).orderBy("reply_id", "pos").collect()
    assert [(r.day_number, r.start_time, r.duration_minutes, r.category) for r in made] == [
        (1, "09:00", 60, "other"), (4, "09:00", 60, "other"), (1, "09:30", 90, "restaurant"), (3, "09:00", 60, "hotel"),
        (5, "09:00", 60, "other"),
    ]
    assert not made[0].confirm_required and not made[0].is_confirmed and made[0].source == "ai"
    lax = spark.createDataFrame(rows, ELEMENT).withColumn("time", F.lit("25:99"))
    imported = replies.imported_items(lax, trips).where("reply_id = 2").first()
    assert (imported.start_time, imported.notes, imported.duration_minutes) == ("25:99", "地點：there", 60)


def test_product_reply(spark):
    given = ['ok {"name":" Pan ","price":"12.5"} bye', '{"name":"","price":0}', "nothing", '{"name":']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "reply_id int, raw string")
    rows = replies.product_reply(df).orderBy("reply_id").collect()
    assert [(r.readable, r.name, r.price) for r in rows] == [
        (True, "Pan", 13), (True, None, None), (False, None, None), (False, None, None),
    ]


def test_prompts(spark):
    answers = spark.createDataFrame([(1, "沖繩", " ", None, "food", "3000", "")],
        "request_id int, destination string, days string, people string, preference string, budget string, extra string")
    prompt = replies.plan_prompts(answers).first().prompt
    assert "- 目的地：沖繩\n- 天數：未提供\n- 成員：未提供\n" in prompt and "- 特殊需求：無\n" in prompt
    assert '  {\n    "day": 1,' in prompt and "{{" not in prompt


def test_contradicting_filters_are_refused(spark, export_tables):
    with pytest.raises(ValueError):
        itinerary.items_filtered(export_tables[1], day=1, only_candidates=True)
    with pytest.raises(ValueError):
        shopping.wishlist_by_status(spark.createDataFrame([], BUY), "open")


def test_trip_without_dates_runs_to_its_last_day(spark):
    trips = spark.createDataFrame([(1, "u", "t", None, None), (2, "u", "t", None, None)], TRIP)
    items = spark.createDataFrame(
        [(1, 1, 2, "a", "09:00", 60, "", "", "", False, False), (2, 2, None, "b", None, 60, "", "", "", False, False)],
        EXPORT_ITEM,
    )
    days = [(r.day_number, r.day_label, r.item_id) for r in itinerary.day_plan(trips, items).orderBy("day_number").collect()]
    assert days == [(1, "Day 1", None), (2, "Day 2", 1)]


def test_cleared_fields_and_folded_patches(spark, export_tables):
    items = export_tables[1]
    patches = spark.createDataFrame(
        [(1, 1, "new", None), (1, 2, None, "12:00"), (1, 3, "newer", None), (2, 1, "x", None)],
        "item_id long, at int, name string, start_time string",
    )
    folded = changes.fold_patches(patches, "at")
    assert {(r.item_id, r.name, r.start_time) for r in folded.collect()} == {(1, "newer", "12:00"), (2, "x", None)}
    back = changes.unschedule_items(items.withColumn("sort_order", F.lit(4)), items.where("id = 1").select("id"))
    row = back.where("id = 1").first()
    assert (row.day_number, row.start_time, row.sort_order) == (None, None, 0)


def test_accepted_patches_can_be_applied(spark):
    trips = spark.createDataFrame([(1, "u", "t", datetime.date(2026, 9, 1), datetime.date(2026, 9, 4))], TRIP)
    items = spark.createDataFrame([(1, 1, 1, "09:00", 60, 0), (2, 1, None, None, 60, 0), (3, 1, 2, "10:00", 60, 0)], PLAN_ITEM)
    patches = spark.createDataFrame(
        [(1, True, None, None), (2, False, 3, " 14:00 "), (3, False, 9, None), (7, False, 1, None), (3, True, 1, None)],
        "item_id long, to_candidate boolean, day_number int, start_time string",
    )
    accepted, rejected = quality.validate_patches(patches, items, trips)
    assert sorted((r.item_id, r.reason) for r in rejected.collect()) == [
        (3, "candidate_with_day"), (3, "day_out_of_range"), (7, "unknown_id"),
    ]
    after = {r.id: (r.day_number, r.start_time) for r in changes.patch_items(items, accepted).collect()}
    assert after == {1: (None, None), 2: (3, "14:00"), 3: (2, "10:00")}


def test_older_files_are_read_and_completed(spark, tmp_path):
    path = str(tmp_path / "items")
    older = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", 30)], "id long, trip_id long, name string, duration_minutes int")
    write_snapshot(older, path, "trip_id")
    read = read_table(spark, path, "itinerary_items")
    assert read.columns == schema("itinerary_items").names and read.where("category is null").count() == 2
    filled = {r.id: (r.category, r.duration_minutes) for r in fill_defaults(older, "itinerary_items").collect()}
    assert filled == {1: ("other", None), 2: ("other", 30)}
    log = spark.createDataFrame([(1, "x")], "trip_id long, instruction string")
    append_log(log, str(tmp_path / "log"))
    append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_summaries(spark):
    from wayledger.operators import changes, itinerary

    trips = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(1, 1, 2, "A", "09:00", True, False, ""), (2, 1, None, "B", None, True, True, "x"), (3, 2, 2, "C", None, False, False, "")]
    items = spark.createDataFrame(
        rows, "id long, trip_id long, day_number int, name string, start_time string, confirm_required boolean, is_confirmed boolean, notes string"
    )
    texts = lambda **which: {r.trip_id: r.summary for r in itinerary.listing_summary(trips, items, **which).collect()}
    assert texts() == {1: "全部項目共 2 筆，其中 1 項必須確認但還沒確認。", 2: "全部項目共 1 筆。", 3: "這趟旅程的全部項目是空的。"}
    assert texts(only_candidates=True)[1] == "候選項目共 1 筆。" and texts(only_candidates=True)[2] == "這趟旅程的候選項目是空的。"
    assert texts(day=2, only_unconfirmed=True)[2] == "第 2 天的項目（僅未確認）共 1 筆。"
    patches = spark.createDataFrame(
        [(1, None, "10:00", None, None, None, ["day_number"]), (2, 3, None, False, "B2", "y", None), (3, None, None, None, None, None, ["start_time", "notes"]), (9, 1, None, None, None, None, None)],
        "item_id long, day_number int, start_time string, is_confirmed boolean, name string, notes string, clear array<string>",
    )
    found = {r.id: r.summary for r in changes.update_summaries(items, patches).collect()}
    assert found == {
        1: "已更新「A」：退回候選；時間改為 10:00。",
        2: "已更新「B2」：排到第 3 天；取消已確認；改了名稱；更新了 notes。",
        3: "已更新「C」：更新了 notes。",
    }
    none = spark.createDataFrame([(3, None)], "item_id long, notes string")
    assert [r.summary for r in changes.update_summaries(items, none).collect()] == ["已更新「C」：無變更。"]
