"""Batch work before and after a language-model call: prompts, reply reading, normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import clock
from wayledger.functions.text import blank_as_null, js_parse_int, js_trim
from wayledger.operators.itinerary import up
from wayledger.operators.skew import HotKeys, ranked

# The categories replies may use, and what stands for missing answers.
REPLY_CATEGORIES = ["restaurant", "hotel", "attraction", "shopping", "transport", "other"]
DEFAULT_TIME = "09:00"
DEFAULT_MINUTES = 60
NOT_GIVEN = "未提供"
NONE_EXTRA = "無"
PLACE = "地點："

# Fixed value: the planning prompt, with a slot per answer.
PLAN_PROMPT = """你是一位專業的旅遊規劃師。請根據以下資訊，為使用者規劃一份詳細的旅遊行程建議。

旅遊資訊：
- 目的地：{destination}
- 天數：{days}
- 成員：{people}
- 偏好：{preference}
- 預算：{budget}
- 特殊需求：{extra}

請回傳一個 JSON 陣列，每個元素代表一個行程項目，格式如下：
[
  {{
    "day": 1,
    "name": "景點或餐廳名稱",
    "category": "attraction 或 restaurant 或 shopping 或 hotel 或 transport 或 other",
    "start_time": "HH:MM",
    "duration_minutes": 90,
    "location": "所在區域或地址",
    "notes": "簡短說明或推薦原因"
  }}
]

規則：
1. 根據天數安排每天的行程，早上約 09:00 開始，合理分配時間
2. 景點大約 90-120 分鐘，餐廳 60-90 分鐘，購物 60-90 分鐘
3. 每天安排 4-6 個項目，包含早餐、午餐、晚餐和景點
4. 行程之間預留合理的移動時間
5. 只回傳 JSON 陣列，不要任何說明文字或 markdown"""

# Fixed value: the text-import prompt, with slots for the day hint and the text.
IMPORT_PROMPT = """你是行程解析器。將以下文字整理成 JSON 陣列，每個元素代表一個行程項目。
只輸出 JSON 陣列本身，不要說明文字、不要 markdown 程式碼框。
每個元素固定包含：
  name: 字串，景點/餐廳/活動名稱（必填）
  day: 整數，第幾天（不確定就用 1）。{hint}
  time: 字串 "HH:MM" 24 小時制（不確定就用 "09:00"）
  category: restaurant/hotel/attraction/transport/shopping/other 之一
  location: 字串，地點或店名（沒有就空字串）
文字如下：
{text}"""
IMPORT_HINT = "本趟共 {days} 天，day 請落在 1~{days}。"


def _filled(template: str, slots: dict[str, Column]) -> Column:
    """A template as one concatenation of its fixed pieces and the slot columns."""
    pieces: list[Column] = []
    rest = template
    for name, value in slots.items():
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before.replace("{{", "{").replace("}}", "}")), value]
    return F.concat(*pieces, F.lit(rest.replace("{{", "{").replace("}}", "}")))


def plan_prompts(answers: DataFrame) -> DataFrame:
    asked = ["destination", "days", "people", "preference", "budget"]
    slots = {name: F.coalesce(blank_as_null(F.col(name)), F.lit(NOT_GIVEN)) for name in asked}
    slots["extra"] = F.coalesce(blank_as_null(F.col("extra")), F.lit(NONE_EXTRA))
    return answers.withColumn("prompt", _filled(PLAN_PROMPT, slots))


def _with_days(rows: DataFrame, trips: DataFrame) -> DataFrame:
    days = clock.total_days(F.col("start_date"), F.col("end_date"))
    span = trips.select(F.col("id").alias("trip_id"), days.alias("total_days"))
    return rows.join(span, "trip_id", "left").fillna(0, ["total_days"])


def import_prompts(texts: DataFrame, trips: DataFrame) -> DataFrame:
    """Prompts for texts that are not blank; a trip with known days gives the day range."""
    first, middle, last = IMPORT_HINT.split("{days}")
    days = F.col("total_days").cast("string")
    hint = F.when(F.col("total_days") > 0, F.concat(F.lit(first), days, F.lit(middle), days, F.lit(last)))
    given = _with_days(texts.withColumn("text", js_trim(F.col("text"))).where(F.col("text") != ""), trips)
    prompt = _filled(IMPORT_PROMPT, {"hint": F.coalesce(hint, F.lit("")), "text": F.col("text")})
    return given.withColumn("prompt", prompt).drop("total_days")


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing sign, null when they do not enclose anything."""
    start = F.instr(text, F.lit(opening))
    tail = F.instr(F.reverse(text), F.lit(closing))
    end = F.length(text) - tail + 1
    return F.when((start > 0) & (tail > 0) & (end > start), text.substr(start, end - start + 1))


def _read_reply(replies: DataFrame) -> DataFrame:
    """Add the cleaned text, the parsed value and its elements."""
    unfenced = F.replace(F.regexp_replace("raw", "(?i)```json", ""), F.lit("```"), F.lit(""))
    cleaned = replies.withColumn("_text", js_trim(F.coalesce(unfenced, F.lit(""))))
    value = F.coalesce(F.try_parse_json("_text"), F.try_parse_json(_between(F.col("_text"), "[", "]")))
    return cleaned.withColumn("_value", value).withColumn(
        "_elements", F.try_variant_get("_value", "$", "array<variant>")
    )


def reply_status(replies: DataFrame) -> DataFrame:
    """Classify replies: empty, unparsable, not_array, empty_array or ok."""
    status = (
        F.when(js_trim(F.coalesce("raw", F.lit(""))) == "", "empty")
        .when(F.col("_value").isNull(), "unparsable")
        .when(F.col("_elements").isNull(), "not_array")
        .when(F.size("_elements") == 0, "empty_array")
        .otherwise("ok")
    )
    return _read_reply(replies).withColumn("status", status).drop("_text", "_value", "_elements")


def reply_elements(replies: DataFrame) -> DataFrame:
    """Elements of readable replies as rows of text fields, each with its position."""
    others = [c for c in replies.columns if c != "raw"]
    each = _read_reply(replies).select(*others, F.posexplode("_elements").alias("pos", "_e"))
    names = ["name", "day", "start_time", "time", "duration_minutes", "category", "location", "notes"]
    return each.select(*others, "pos", *[F.try_variant_get("_e", f"$.{n}", "string").alias(n) for n in names])


def _text(rows: DataFrame, name: str) -> Column:
    return js_trim(F.coalesce(F.col(name), F.lit(""))) if name in rows.columns else F.lit("")


def _whole_number(name: str) -> Column:
    """Leading whole number of a field, no larger than its column can hold."""
    number = js_parse_int(F.col(name))
    return F.when(number.isNotNull(), F.least(number, F.lit(2**31 - 1).cast("long")))


def _common(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Named elements with their day and category made legal."""
    named = rows.withColumn("name", _text(rows, "name")).where(F.col("name") != "")
    day = F.greatest(F.coalesce(_whole_number("day"), F.lit(1)), F.lit(1))
    within = F.when((F.col("total_days") > 0) & (day > F.col("total_days")), F.col("total_days")).otherwise(day)
    category = F.lower(_text(rows, "category"))
    legal = F.when(category.isin(REPLY_CATEGORIES), category).otherwise("other")
    return _with_days(named, trips).withColumns({"day_number": within.cast("int"), "category": legal})


def _two_digit_hour(time: Column, grammar: str) -> Column:
    return F.when(clock.valid_time(time, grammar), F.lpad(time, 5, "0")).otherwise(DEFAULT_TIME)


def suggested_items(reply_rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Reply elements as item rows: illegal values replaced, nameless ones dropped."""
    rows = _common(reply_rows, trips)
    minutes = _whole_number("duration_minutes")
    return rows.select(
        "reply_id",
        "trip_id",
        "pos",
        "name",
        "day_number",
        _two_digit_hour(_text(reply_rows, "start_time"), "suggestion").alias("start_time"),
        F.when(minutes > 0, minutes).otherwise(DEFAULT_MINUTES).cast("int").alias("duration_minutes"),
        "category",
        _text(reply_rows, "location").alias("location"),
        _text(reply_rows, "notes").alias("notes"),
        F.lit(False).alias("confirm_required"),
        F.lit(False).alias("is_confirmed"),
        F.lit("ai").alias("source"),
    )


def imported_items(reply_rows: DataFrame, trips: DataFrame) -> DataFrame:
    """The text-import form: field ``time``, fixed length, the place told in the notes."""
    rows = _common(reply_rows, trips)
    place = _text(reply_rows, "location")
    return rows.select(
        "reply_id",
        "trip_id",
        "pos",
        "name",
        "day_number",
        _two_digit_hour(_text(reply_rows, "time"), "lax").alias("start_time"),
        F.lit(DEFAULT_MINUTES).alias("duration_minutes"),
        "category",
        F.when(place != "", F.concat(F.lit(PLACE), place)).otherwise("").alias("notes"),
        F.lit("").alias("booking_ref"),
        F.lit(False).alias("confirm_required"),
        F.lit(False).alias("is_confirmed"),
    )


def suggestions_by_day(suggested: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Position of each suggestion in its reply, by day and time."""
    return ranked(suggested, ["reply_id"], up("day_number", "start_time", "pos"), hot=hot)


def import_result(reply_rows: DataFrame) -> DataFrame:
    """Per reply: elements read, dropped for want of a name, and kept."""
    kept = F.count_if(_text(reply_rows, "name") != "")
    counts = reply_rows.groupBy("reply_id").agg(F.count("*").alias("parsed"), kept.alias("kept"))
    return counts.withColumn("dropped", F.col("parsed") - F.col("kept"))


def product_reply(replies: DataFrame) -> DataFrame:
    """Name and price of a product reply; price only when positive, rounded."""
    value = F.try_parse_json(_between(F.col("raw"), "{", "}"))
    read = replies.withColumn("_value", value)
    price = F.try_variant_get("_value", "$.price", "double")
    return read.select(
        "reply_id",
        F.col("_value").isNotNull().alias("readable"),
        js_trim(F.nullif(F.try_variant_get("_value", "$.name", "string"), F.lit(""))).alias("name"),
        F.when(price > 0, F.floor(price + 0.5)).alias("price"),
    )
