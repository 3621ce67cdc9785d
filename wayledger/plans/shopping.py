"""Queries on the shopping lists."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayledger.operators import shopping
from wayledger.plans.registry import query

AS_OF = datetime.datetime(2001, 8, 15)
CATEGORY_ORDER = ["cat0", "cat1", "cat2", "cat3", "cat4", "cat5", "cat6", "其他"]

_TAG = "trim(coalesce(tag, ''))"
_CATEGORY = "coalesce(nullif(category, ''), '其他')"
_ACTIVE = "(this_month and not bought)"
_URGENCY = "case urgency when 'need' then 0 when 'want' then 1 when 'maybe' then 2 else 9 end"
_DAYS = "cast(floor(date_diff('second', created_at, timestamp '2001-08-15') / 86400) as bigint)"


def _money(c: str) -> str:
    return f"'NT$ ' || format('{{:,}}', cast(floor(coalesce({c}, 0) + 0.5) as bigint))"


def _rank(order: str, where: str = "true", table: str = "buylist_items") -> str:
    return (
        f"select list_id, id, row_number() over (partition by list_id order by {order}, id) as rank "
        f"from {table} where {where}"
    )


def _searched(text: str) -> str:
    return " or ".join(f"contains(lower(coalesce({c}, '')), '{text}')" for c in ("name", "note", "tag", "category"))


@query("buylist_visible", f"select list_id, id from buylist_items where ({_searched('100%_s')}) and {_ACTIVE}")
def _(t):
    return shopping.buylist_visible(t.buylist_items, search=" 100%_S ", status="month").select("list_id", "id")


@query(
    "buylist_visible_tag",
    f"select list_id, id from buylist_items where bought and {_CATEGORY} = '其他' and {_TAG} = 'Japan'",
)
def _(t):
    shown = shopping.buylist_visible(t.buylist_items, status="bought", category_is="其他", tag="Japan")
    return shown.select("list_id", "id")


@query("buylist_this_month", f"select list_id, id from buylist_items where {_ACTIVE}")
def _(t):
    return shopping.buylist_this_month(t.buylist_items).select("list_id", "id")


@query("repurchase_candidates", _rank("created_at desc nulls first", "bought and starred"))
def _(t):
    return shopping.repurchase_candidates(t.buylist_items).select("list_id", "id", "rank")


@query(
    "wishlist_by_status",
    """select list_id, id, 'pending' as status,
         row_number() over (partition by list_id order by created_at desc, id) as rank
       from buylist_items where not bought""",
)
def _(t):
    return shopping.wishlist_by_status(t.buylist_items, " Pending").select("list_id", "id", "status", "rank")


@query(
    "legacy_wishlist",
    """select username, status, id, row_number() over (partition by username, status order by id) as rank,
         count(*) over (partition by username, status) as section_size from wishlist""",
)
def _(t):
    return shopping.legacy_wishlist(t.wishlist).select("username", "status", "id", "rank", "section_size")


@query("sauces_ranked", _rank("repurchase desc, created_at desc", "contains(lower(name), 'supplier')", "sauces"))
def _(t):
    return shopping.sauces_ranked(t.sauces, "SUPPLIER ").select("list_id", "id", "rank")


@query(
    "urgency_labels",
    """select id, case urgency when 'need' then '需要' when 'want' then '想要' else '再看看' end as urgency_label,
      case accessibility when 'overseas' then '需國外' when 'rare' then '稀有難找' else '台灣容易' end as access_label,
      case urgency when 'need' then '很想要' when 'want' then '想要' when 'maybe' then '還在考慮' else '' end
        as public_label from buylist_items""",
)
def _(t):
    shown = shopping.urgency_labels(t.buylist_items)
    return shown.select("id", "urgency_label", "access_label", "public_label")


@query(
    "price_difference",
    f"""select id, case when not bought or actual_price is null then '' when actual_price = price then '持平'
      when actual_price < price then '省 ' || {_money('price - actual_price')}
      else '超 ' || {_money('actual_price - price')} end as difference from buylist_items""",
)
def _(t):
    return shopping.price_difference(t.buylist_items).select("id", "difference")


@query(
    "days_wanted",
    f"""select id, {_DAYS} as days, case when {_DAYS} <= 0 then '今天加入' else '想買了 ' || {_DAYS} || ' 天' end
      as days_label from buylist_items""",
)
def _(t):
    return shopping.days_wanted(t.buylist_items, AS_OF).select("id", "days", "days_label")


_DEFAULT = f"bought, {_ACTIVE} desc, {_URGENCY}, created_at desc"


@query("buylist_sort_default", _rank(_DEFAULT))
def _(t):
    return shopping.buylist_sort_default(t.buylist_items).select("list_id", "id", "rank")


@query("buylist_sort_price", _rank("bought, coalesce(price, 0) desc, created_at"))
def _(t):
    return shopping.buylist_sort_price(t.buylist_items).select("list_id", "id", "rank")


@query("buylist_sort_days", _rank(f"bought, {_DAYS} desc, created_at"))
def _(t):
    return shopping.buylist_sort_days(t.buylist_items, AS_OF).select("list_id", "id", "rank")


BUDGET_SQL = """with sums as (select list_id, sum(case when this_month and not bought then price else 0 end) as total,
       sum(case when this_month and not bought then recurring_cost else 0 end) as recurring
     from {items} group by list_id),
  b as (select coalesce(g.list_id, s.list_id) as list_id, coalesce(monthly_budget, 0) as budget,
       coalesce(total, 0) as total, coalesce(recurring, 0) as recurring
     from buylist_budget g full join sums s on g.list_id = s.list_id)
  select list_id, cast(budget as double) as budget, cast(total as double) as total,
    cast(case when budget <> 0 then budget - total end as double) as remaining,
    cast(case when budget <> 0 and budget < total then total - budget end as double) as overspend,
    cast(recurring as double) as recurring,
    case when budget = 0 then 'none' when budget >= total then 'ok' else 'over' end as status from b"""


def budget_columns(df):
    money = ["budget", "total", "remaining", "overspend", "recurring"]
    return df.select("list_id", "status", *[F.col(c).cast("double") for c in money])


@query("budget_status", BUDGET_SQL.format(items="buylist_items"))
def _(t):
    return budget_columns(shopping.budget_status(t.buylist_budget, t.buylist_items))


def rollup_sql(items: str, order: list[str]) -> str:
    """Categories of the lists in a table of items, with the place of each among ``order``."""
    known = ", ".join(f"'{c}'" for c in order)
    return f"""v as (select *, {_CATEGORY} as cat, row_number() over (partition by list_id order by {_DEFAULT}, id) as r
         from {items}),
       g as (select list_id, cat as category, count(*) as items, count(*) filter (not bought) as unbought,
         cast(coalesce(sum(price) filter (not bought), 0) as double) as unbought_sum, min(r) as first
         from v group by list_id, cat)
       select list_id, category, items, unbought, unbought_sum, unbought = 0 as all_bought,
         row_number() over (partition by list_id order by list_position([{known}], category) nulls last, first)
           as place from g"""


@query("category_rollup", f"with {rollup_sql('buylist_items', CATEGORY_ORDER)}")
def _(t):
    groups = shopping.category_rollup(shopping.buylist_visible(t.buylist_items), CATEGORY_ORDER)
    return groups.withColumn("unbought_sum", F.col("unbought_sum").cast("double"))


_MATRIX = """wanted as (select * from buylist_items where this_month and not bought),
    med as (select list_id, list_sort(list(price))[len(list(price)) // 2 + 1] as m from wanted group by list_id),
    cells as (select wanted.list_id, wanted.id, wanted.price,
      case when price >= m and m > 0 then 'hi' else 'lo' end || '-' ||
      case when urgency in ('need', 'want') then 'need' else 'low' end as cell
      from wanted join med on wanted.list_id = med.list_id)"""


@query("price_urgency_matrix", f"with {_MATRIX} select list_id, id, cell from cells")
def _(t):
    return shopping.price_urgency_matrix(t.buylist_items).select("list_id", "id", "cell")


@query(
    "matrix_counts",
    f"""with {_MATRIX},
      spine as (select distinct list_id, c.cell from buylist_items,
        (values ('lo-need'), ('hi-need'), ('lo-low'), ('hi-low')) as c(cell))
      select spine.list_id, spine.cell, count(cells.id) as items, cast(coalesce(sum(price), 0) as double) as price_sum
      from spine left join cells on spine.list_id = cells.list_id and spine.cell = cells.cell
      group by spine.list_id, spine.cell""",
)
def _(t):
    counts = shopping.matrix_counts(t.buylist_items)
    return counts.withColumn("price_sum", F.col("price_sum").cast("double"))


@query(
    "distinct_tags",
    f"""select list_id, tag, row_number() over (partition by list_id order by tag) as rank
      from (select distinct list_id, {_TAG} as tag from buylist_items where {_TAG} <> '')""",
)
def _(t):
    return shopping.distinct_tags(t.buylist_items)


@query(
    "reset_vanished_tag",
    f"""select list_id, case when exists (select 1 from buylist_items b where b.list_id = g.list_id
        and trim(b.tag) = 'tag2') then 'tag2' else 'all' end as tag from buylist_budget g""",
)
def _(t):
    chosen = t.buylist_budget.select("list_id", F.lit("tag2").alias("tag"))
    return shopping.reset_vanished_tag(t.buylist_items, chosen)


@query(
    "tag_unbought_counts",
    f"select list_id, {_TAG} as tag, count(*) filter (not bought) as unbought from buylist_items group by 1, 2",
)
def _(t):
    return shopping.tag_unbought_counts(t.buylist_items)


@query(
    "list_headline",
    """with r as (select *, row_number() over (partition by list_id order by created_at desc, id) as k,
        count(*) over (partition by list_id) as n from buylist_items where not bought)
    select list_id, n, '購物清單還沒買的共 ' || n || ' 筆，例如：' || string_agg(name, '、' order by k) || '。' as summary
    from r where k <= 3 group by list_id, n""",
)
def _(t):
    return shopping.list_headline(t.buylist_items, "pending").select("list_id", "n", "summary")


@query(
    "markdown_totals",
    """select list_id, count(*) as items, cast(coalesce(sum(price) filter (not bought), 0) as double) as unbought_total
    from buylist_items group by list_id""",
)
def _(t):
    totals = shopping.markdown_totals(t.buylist_items)
    return totals.withColumn("unbought_total", F.col("unbought_total").cast("double"))


@query(
    "bulk_add_rows",
    r"""with cut as (select list_id, regexp_split_to_array(text, '[\n,、，]+') as parts from pastes),
      each as (select list_id, unnest(parts) as part, unnest(range(len(parts))) as spot from cut),
      named as (select list_id, spot,
        regexp_replace(part, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g') as name from each),
      once as (select list_id, name, min(spot) as spot from named where name <> '' group by list_id, name)
    select list_id, cast(row_number() over (partition by list_id order by spot) - 1 as int) as pos, name,
      'maybe' as urgency, true as this_month, 1 as quantity from once""",
)
def _(t):
    return shopping.bulk_add_rows(t.pastes).select("list_id", "pos", "name", "urgency", "this_month", "quantity")


@query(
    "repurchase_copy",
    f"""select id as source_id, list_id, name, cast(price as double) as price, coalesce(urgency, 'maybe') as urgency,
      {_CATEGORY} as category, quantity, tag, 'user-1' as added_by, '2001-08-15 00:00:00' as created_at, bought and false
      as bought from buylist_items where bought and starred""",
)
def _(t):
    copies = shopping.repurchase_copy(t.buylist_items, t.buylist_items.select("id"), "user-1", AS_OF)
    return copies.select(
        "source_id", "list_id", "name", F.col("price").cast("double"), "urgency", "category", "quantity", "tag",
        "added_by", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "bought",
    )


@query(
    "monthly_rollover",
    """select b.list_id, b.id from buylist_items b left join buylist_budget g on b.list_id = g.list_id
      where not (bought and coalesce(last_cleared, '') not in ('', '2001-08'))""",
)
def _(t):
    return shopping.monthly_rollover(t.buylist_budget, t.buylist_items, AS_OF)[1].select("list_id", "id")


@query("monthly_rollover_budget", "select list_id, '2001-08' as last_cleared from buylist_budget")
def _(t):
    return shopping.monthly_rollover(t.buylist_budget, t.buylist_items, AS_OF)[0].select("list_id", "last_cleared")
