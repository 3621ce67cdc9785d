"""Calendar, map, link, Markdown and share exports.

Documents come as ordered parts (see ``text_parts``): an ordinary trip or list is one
part, 0, holding the whole text; a longer one continues in parts 1, 2, ...
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import clock
from wayledger.functions.money import exact_sum, money_text, or_zero
from wayledger.functions.text import component_encode, csv_escape, form_encode, ics_escape, js_trim
from wayledger.operators.itinerary import down, labelled, not_true, up
from wayledger.operators.quality import TAG_LENGTH
from wayledger.operators.shopping import (
    PUBLIC_URGENCY_LABELS,
    URGENCY_LABELS,
    flag,
    trimmed_tag,
)
from wayledger.operators.skew import HotKeys, document_parts, hot_keys, ranked, spread_under

# Formats, labels and addresses of the exported texts.
CSV_HEADER = ["name", "location", "day", "time", "notes"]
PUBLIC_FIELDS = ["id", "name", "price", "quantity", "category", "tag", "note", "link", "urgency"]
BOOKING = "預約編號："
CALENDAR_NAME = "行程"
NO_TAG = "未分情境"
CALENDAR_LINK = "https://calendar.google.com/calendar/render?action=TEMPLATE&"
MAP_LINK = "https://www.google.com/maps/search/?api=1&query="
# Ours, not part of the format: the product and domain named in calendar files.
PRODUCT = "-//Wayledger//Itinerary Export//ZH-TW"
DOMAIN = "wayledger.local"
CRLF = "\r\n"


def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _details() -> Column:
    """Booking line and notes, whichever are filled in."""
    return F.concat_ws("\n", F.concat(F.lit(BOOKING), _present("booking_ref")), _present("notes"))


def ics_events(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Scheduled items with floating start and end stamps."""
    starts = trips.where(F.col("start_date").isNotNull()).select(
        F.col("id").alias("trip_id"), F.col("name").alias("trip_name"), "start_date"
    )
    dated = items.where(F.col("day_number").isNotNull()).join(starts, "trip_id")
    begin = clock.export_start_minutes(F.col("start_time"))
    until = begin + clock.event_minutes(F.col("duration_minutes"))
    return dated.withColumns(
        {
            "start_stamp": clock.local_stamp(F.col("start_date"), F.col("day_number"), begin),
            "end_stamp": clock.local_stamp(F.col("start_date"), F.col("day_number"), until),
        }
    )


def ics_documents(
    trips: DataFrame, items: DataFrame, as_of: datetime.datetime, product: str = PRODUCT, domain: str = DOMAIN
) -> DataFrame:
    """One calendar file per trip that has scheduled items, events in checklist order."""
    stamp = as_of.strftime("%Y%m%dT%H%M%SZ")

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value, F.lit(CRLF))

    details = F.nullif(_details(), F.lit(""))
    uid = F.concat(
        F.lit("trip-"), F.col("trip_id").cast("string"), F.lit("-"), F.col("id").cast("string"), F.lit(f"@{domain}")
    )
    block = F.concat(
        F.lit(f"BEGIN:VEVENT{CRLF}"),
        line("UID:", uid),
        F.lit(f"DTSTAMP:{stamp}{CRLF}"),
        line("DTSTART:", F.col("start_stamp")),
        line("DTEND:", F.col("end_stamp")),
        line("SUMMARY:", ics_escape(F.coalesce("name", F.lit("")))),
        F.coalesce(line("LOCATION:", ics_escape(_present("location"))), F.lit("")),
        F.coalesce(line("DESCRIPTION:", ics_escape(details)), F.lit("")),
        F.lit(f"END:VEVENT{CRLF}"),
    )
    events = ics_events(trips, items).withColumn("block", block)
    order = [*down("confirm_required"), *up("is_confirmed", "day_number", "start_time", "id")]
    hot = hot_keys(items, ["trip_id"])
    placed = ranked(events, ["trip_id"], order, "_pos", hot)
    parts = document_parts(placed, ["trip_id"], "_pos", "block", hot, extras={"trip_name": F.first("trip_name")})
    head = F.concat(
        F.lit(f"BEGIN:VCALENDAR{CRLF}VERSION:2.0{CRLF}PRODID:{product}{CRLF}CALSCALE:GREGORIAN{CRLF}"),
        line("X-WR-CALNAME:", ics_escape(F.coalesce(_present("trip_name"), F.lit(CALENDAR_NAME)))),
    )
    return _document(parts, ["trip_id"], head, F.lit(f"END:VCALENDAR{CRLF}"))


def _document(parts: DataFrame, keys: list[str], head: Column, tail: Column) -> DataFrame:
    text = F.concat(
        F.when(F.col("part") == 0, head).otherwise(""), "body", F.when(F.col("_last"), tail).otherwise("")
    )
    return parts.select(*keys, "part", text.alias("document"))


def maps_csv_rows(items: DataFrame) -> DataFrame:
    """Items with a place as map rows; candidates keep day and time blank."""
    placed = items.where(js_trim(F.coalesce("location", F.lit(""))) != "")
    time = F.when(F.col("day_number").isNotNull(), F.col("start_time"))
    return placed.select(
        "trip_id",
        "id",
        "name",
        "location",
        F.coalesce(F.col("day_number").cast("string"), F.lit("")).alias("day"),
        F.coalesce(time, F.lit("")).alias("time"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        "confirm_required",
        "is_confirmed",
        "day_number",
        "start_time",
    )


def maps_csv_documents(items: DataFrame) -> DataFrame:
    """One CSV text per trip that has places, rows in checklist order."""
    cells = F.concat_ws(",", *[csv_escape(F.col(c)) for c in CSV_HEADER])
    rows = maps_csv_rows(items).withColumn("line", F.concat(cells, F.lit(CRLF)))
    order = [*down("confirm_required"), *up("is_confirmed", "day_number", "start_time", "id")]
    hot = hot_keys(items, ["trip_id"])
    placed = ranked(rows, ["trip_id"], order, "_pos", hot)
    # No closing text, so nothing asks which part is the last and Catalyst drops what would tell.
    parts = document_parts(placed, ["trip_id"], "_pos", "line", hot)
    return _document(parts, ["trip_id"], F.lit(",".join(CSV_HEADER) + CRLF), F.lit(""))


def write_maps_csv(items: DataFrame, path: str, folders: int = 256) -> None:
    """Write the map rows as CSV files, grouped into a fixed number of folders by trip."""
    rows = maps_csv_rows(items).select("trip_id", *CSV_HEADER)
    spread = rows.withColumn("trip_folder", F.pmod(F.hash("trip_id"), F.lit(folders)))
    spread.write.partitionBy("trip_folder").csv(path, header=True, quote='"', escape='"')


def calendar_links(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Add-to-calendar link of each scheduled item."""

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), form_encode(value))

    dates = F.concat("start_stamp", F.lit("/"), "end_stamp")
    query = F.concat_ws(
        "&",
        field("text", F.coalesce("name", F.lit(""))),
        field("dates", dates),
        field("details", F.nullif(_details(), F.lit(""))),
        field("location", _present("location")),
    )
    return ics_events(trips, items).select("trip_id", "id", F.concat(F.lit(CALENDAR_LINK), query).alias("link"))


def map_links(items: DataFrame) -> DataFrame:
    """Map search link of each item with a place."""
    place = js_trim(F.coalesce("location", F.lit("")))
    link = F.concat(F.lit(MAP_LINK), component_encode(place))
    return items.where(place != "").select("trip_id", "id", link.alias("link"))


def buylist_markdown(buylist: DataFrame) -> DataFrame:
    """One Markdown text per list: sections by tag, unbought before bought, totals last."""
    name = F.when(flag("bought"), F.concat(F.lit("~~"), "name", F.lit("~~"))).otherwise(F.col("name"))
    count = F.when(F.col("quantity") > 1, F.concat(F.lit("　×"), F.col("quantity").cast("string"))).otherwise("")
    urgency = labelled(F.col("urgency"), URGENCY_LABELS, URGENCY_LABELS["maybe"])
    line = F.concat(
        F.lit("- "), name, F.lit("　"), money_text(F.col("price")), count, F.lit("　["), urgency, F.lit("]\n")
    )
    unbought = F.when(~flag("bought"), or_zero(F.col("price"))).cast("decimal(20,2)")
    rows = buylist.select(
        "list_id",
        trimmed_tag().alias("tag"),
        F.lit(1).alias("kind"),
        flag("bought").alias("bought"),
        "created_at",
        "id",
        line.alias("line"),
        unbought.alias("amount"),
    )
    title = F.when(F.col("tag") == "", F.lit(NO_TAG)).otherwise(F.col("tag"))
    titles = rows.groupBy("list_id", "tag").agg(F.lit(0).alias("kind"))
    titles = titles.withColumn("line", F.concat(F.lit("## "), title, F.lit("\n")))
    lines = rows.unionByName(titles, allowMissingColumns=True)
    order = [(F.col("tag") == "").asc(), *up("tag", "kind", "bought", "created_at", "id")]
    # A blank line ends every section; it is written in front of all titles but the first.
    hot = hot_keys(buylist, ["list_id"])
    placed = ranked(lines, ["list_id"], order, "_line_no", hot)
    gap = F.when((F.col("kind") == 0) & (F.col("_line_no") > 1), F.lit("\n")).otherwise("")
    placed = placed.withColumn("line", F.concat(gap, "line"))
    sums = {"_items": F.count("id"), "_amount": exact_sum(F.col("amount"))}
    totalled = document_parts(placed, ["list_id"], "_line_no", "line", hot, sums)
    tail = F.concat(
        F.lit("\n> 共 "), F.col("_items").cast("string"), F.lit(" 項，未購合計 "), money_text(F.col("_amount"))
    )
    return _document(totalled, ["list_id"], F.lit(""), tail)


def _valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a usable tag; the asked tag is trimmed, the stored one is not."""
    tag = js_trim(F.coalesce("tag", F.lit("")))
    asked = requests.select("list_id", tag.alias("tag")).where(F.col("tag") != "")
    return asked.where(F.length("tag") <= TAG_LENGTH).distinct()


def public_share(buylist: DataFrame, requests: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Unbought items of each asked tag, allowed columns only, dearest first."""
    label = labelled(F.col("urgency"), PUBLIC_URGENCY_LABELS, "")
    open_items = buylist.where(not_true("bought")).select("list_id", *PUBLIC_FIELDS, label.alias("urgency_label"))
    shared = open_items.join(_valid_requests(requests), ["list_id", "tag"], "left_semi")
    hot = hot or hot_keys(buylist, ["list_id", "tag"])
    return ranked(shared, ["list_id", "tag"], [*down("price"), *up("id")], hot=hot)


def share_json(buylist: DataFrame, requests: DataFrame) -> DataFrame:
    """The public extract as one JSON text per request; nothing to show gives count 0."""
    keys = ["list_id", "tag"]
    fields = F.struct(*PUBLIC_FIELDS, "urgency_label")
    entry = F.concat(F.lit(","), F.to_json(fields, {"ignoreNullFields": "false"}))
    hot = hot_keys(buylist, keys)
    rows = public_share(buylist, requests, hot).withColumn("entry", entry)
    marked = document_parts(rows, keys, "rank", "entry", hot, {"_n": F.count("*")})
    joined = spread_under(_valid_requests(requests), marked, keys, "part", hot).fillna(0, ["part", "_n"])
    body = F.when(F.col("part") == 0, F.substr("body", F.lit(2))).otherwise(F.col("body"))
    head = F.concat(
        F.lit('{"tag":'), F.to_json(F.array("tag")).substr(F.lit(2), F.length(F.to_json(F.array("tag"))) - 2),
        F.lit(',"count":'), F.col("_n").cast("string"), F.lit(',"items":['),
    )
    text = F.concat(
        F.when(F.col("part") == 0, head).otherwise(""),
        F.coalesce(body, F.lit("")),
        F.when(F.coalesce("_last", F.lit(True)), F.lit("]}")).otherwise(""),
    )
    return joined.select(*keys, "part", text.alias("document"))
