"""Queries on prompts and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.operators import replies
from wayledger.operators.skew import hot_keys
from wayledger.plans.registry import query


def _sql_text(template: str, slots: dict[str, str]) -> str:
    """A prompt as an SQL concatenation, built apart from the operator."""
    out = template.replace("'", "''").replace("{{", "\0").replace("}}", "\1")
    for name, value in slots.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return "'" + out.replace("\0", "{").replace("\1", "}") + "'"


_ASKED = {c: f"coalesce(nullif(trim({c}), ''), '未提供')" for c in "destination days people preference budget".split()}
_ASKED["extra"] = "coalesce(nullif(trim(extra), ''), '無')"


@query("plan_prompts", f"select request_id, {_sql_text(replies.PLAN_PROMPT, _ASKED)} as prompt from answers")
def _(t):
    return replies.plan_prompts(t.answers).select("request_id", "prompt")


_HINT = "case when days > 0 then '本趟共 ' || days || ' 天，day 請落在 1~' || days || '。' else '' end"
_TRIM = r"regexp_replace({c}, '^[\t\n\x0B\f\r\p{{Z}}\x{{FEFF}}]+|[\t\n\x0B\f\r\p{{Z}}\x{{FEFF}}]+$', '', 'g')"
_TRIM_TEXT = _TRIM.format(c="text")


@query(
    "import_prompts",
    f"""select request_id, md5({_sql_text(replies.IMPORT_PROMPT, {'hint': _HINT, 'text': 'body'})}) as prompt_hash,
      days > 0 as with_hint
    from (select request_id, {_TRIM_TEXT} as body, coalesce(date_diff('day', start_date, end_date) + 1, 0) as days
      from plan_texts left join trips on trip_id = trips.id) where body <> ''""",
)
def _(t):
    prompts = replies.import_prompts(t.plan_texts, t.trips)
    hinted = F.col("prompt").contains("本趟共 ")
    return prompts.select("request_id", F.md5("prompt").alias("prompt_hash"), hinted.alias("with_hint"))


_READ = r"""cleaned as (select reply_id, trip_id, trim(coalesce(raw, '')) as whole,
      trim(replace(regexp_replace(coalesce(raw, ''), '```json', '', 'gi'), '```', ''), chr(10) || ' ') as c from replies),
    parsed as (select *, case when json_valid(c) then c when json_valid(regexp_extract(c, '(?s)\[.*\]')) then
      regexp_extract(c, '(?s)\[.*\]') end as j from cleaned)"""


@query(
    "reply_status",
    f"""with {_READ} select reply_id, case when whole = '' then 'empty' when j is null then 'unparsable'
      when json_type(j) <> 'ARRAY' then 'not_array' when json_array_length(j) = 0 then 'empty_array' else 'ok' end
      as status from parsed""",
)
def _(t):
    return replies.reply_status(t.replies).select("reply_id", "status")


@query(
    "reply_elements",
    f"""with {_READ}, each as (select reply_id, j, unnest(range(cast(json_array_length(j) as bigint))) as k from parsed
      where json_type(j) = 'ARRAY')
    select reply_id, cast(k as int) as pos, json_extract_string(j, '$[' || k || '].name') as name,
      json_extract_string(j, '$[' || k || '].day') as day,
      json_extract_string(j, '$[' || k || '].start_time') as start_time,
      json_extract_string(j, '$[' || k || '].duration_minutes') as duration_minutes from each""",
)
def _(t):
    return replies.reply_elements(t.replies).select("reply_id", "pos", "name", "day", "start_time", "duration_minutes")


_SUGGESTED = r"""spans as (select id, date_diff('day', start_date, end_date) + 1 as total from trips),
    lead as (select r.*, trim(r.name) as nm, coalesce(total, 0) as total,
      try_cast(regexp_extract(trim(day), '^[+-]?[0-9]+') as bigint) as dnum,
      try_cast(regexp_extract(trim(duration_minutes), '^[+-]?[0-9]+') as bigint) as mnum,
      lower(trim(coalesce(category, ''))) as cat, trim(coalesce(start_time, '')) as tm, trim(location) as loc
      from reply_rows r left join spans on spans.id = r.trip_id where trim(r.name) <> ''),
    dayed as (select *, case when dnum is null or dnum < 1 then 1 when total > 0 and dnum > total then total else dnum
      end as d, case when cat in ('restaurant', 'hotel', 'attraction', 'shopping', 'transport', 'other') then cat
      else 'other' end as c from lead),
    suggested as (select *, case when regexp_full_match(tm, '([01]?[0-9]|2[0-3]):[0-5][0-9]') then lpad(tm, 5, '0')
      else '09:00' end as t from dayed)"""


@query(
    "suggested_items",
    f"""with {_SUGGESTED} select reply_id, trip_id, pos, nm as name, cast(d as int) as day_number, t as start_time,
      cast(case when mnum > 0 then mnum else 60 end as int) as duration_minutes, c as category, loc as location,
      '' as notes, false as confirm_required, false as is_confirmed, 'ai' as source from suggested""",
)
def _(t):
    return replies.suggested_items(t.reply_rows, t.trips)


@query(
    "imported_items",
    f"""with {_SUGGESTED} select reply_id, trip_id, pos, nm as name, cast(d as int) as day_number,
      case when regexp_full_match(tm, '[0-9]{{1,2}}:[0-9]{{2}}') then lpad(tm, 5, '0') else '09:00' end as start_time,
      60 as duration_minutes, c as category, case when loc <> '' then '地點：' || loc else '' end as notes,
      '' as booking_ref, false as confirm_required, false as is_confirmed from suggested""",
)
def _(t):
    return replies.imported_items(t.reply_rows.withColumnRenamed("start_time", "time"), t.trips)


@query(
    "suggestions_by_day",
    f"""with {_SUGGESTED} select reply_id, pos, cast(d as int) as day_number, t as start_time,
      row_number() over (partition by reply_id order by d, t, pos) as rank from suggested""",
)
def _(t):
    hot = hot_keys(t.reply_rows, ["reply_id"])
    placed = replies.suggestions_by_day(replies.suggested_items(t.reply_rows, t.trips), hot)
    return placed.select("reply_id", "pos", "day_number", "start_time", "rank")


@query(
    "import_result",
    """select reply_id, count(*) as parsed, count(*) filter (trim(name) <> '') as kept,
      count(*) filter (trim(name) = '') as dropped from reply_rows group by reply_id""",
)
def _(t):
    return replies.import_result(t.reply_rows)


@query(
    "product_reply",
    r"""with found as (select reply_id, regexp_extract(raw, '(?s)\{.*\}') as j from product_replies)
    select reply_id, coalesce(json_valid(j), false) as readable,
      case when json_valid(j) then trim(nullif(json_extract_string(j, '$.name'), '')) end as name,
      cast(case when json_valid(j) then floor(case when try_cast(json_extract_string(j, '$.price') as double) > 0
        then try_cast(json_extract_string(j, '$.price') as double) end + 0.5) end as bigint) as price from found""",
)
def _(t):
    return replies.product_reply(t.product_replies)
