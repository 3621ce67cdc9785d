"""Shopping lists: filters, order, budget, categories, price/urgency matrix, bulk input."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.money import exact_sum, money_text, or_zero
from wayledger.functions.text import js_trim, text_or
from wayledger.operators.itinerary import down, headline, is_true, labelled, not_true, up
from wayledger.operators.selection import nth_values
from wayledger.operators.skew import HotKeys, hot_keys, ranked, salted_lookup

# Labels shown for stored codes, the category order, the urgency order.
URGENCY_LABELS = {"need": "需要", "want": "想要", "maybe": "再看看"}
ACCESS_LABELS = {"tw_easy": "台灣容易", "overseas": "需國外", "rare": "稀有難找"}
PUBLIC_URGENCY_LABELS = {"need": "很想要", "want": "想要", "maybe": "還在考慮"}
CATEGORIES = ["3C", "家電", "服飾", "美妝", "食品", "生活", "書籍", "其他"]
DEFAULT_CATEGORY = "其他"
SCOPES = {"pending": "還沒買的", "purchased": "已買到的", None: "全部"}
CELLS = ["lo-need", "hi-need", "lo-low", "hi-low"]
DAY_SECONDS = 86_400


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def active() -> Column:
    """Wanted this month and not bought."""
    return flag("this_month") & ~flag("bought")


def wanted() -> Column:
    """``active`` as a filter."""
    return is_true("this_month") & not_true("bought")


def category() -> Column:
    return text_or(F.col("category"), DEFAULT_CATEGORY)


def trimmed_tag() -> Column:
    return js_trim(F.coalesce("tag", F.lit("")))


def urgency_rank() -> Column:
    return (
        F.when(F.col("urgency") == "need", 0).when(F.col("urgency") == "want", 1).when(F.col("urgency") == "maybe", 2)
    ).otherwise(9)


def age_days(as_of: datetime.datetime) -> Column:
    seconds = F.unix_seconds(F.lit(as_of)) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return F.floor(seconds / DAY_SECONDS)


def buylist_visible(
    buylist: DataFrame, search: str = "", status: str = "all", category_is: str = "all", tag: str = "all"
) -> DataFrame:
    """Items matching every given filter; the search text is literal, never a pattern."""
    out = buylist
    sought = search.strip().lower()
    if sought:
        fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "note", "tag", "category")]
        out = out.where(F.greatest(*[f.contains(sought) for f in fields]))
    conditions = {"month": wanted(), "bought": is_true("bought"), "starred": is_true("bought") & is_true("starred")}
    if status in conditions:
        out = out.where(conditions[status])
    if category_is != "all":
        out = out.where(category() == category_is)
    return out if tag == "all" else out.where(trimmed_tag() == tag)


def buylist_this_month(buylist: DataFrame) -> DataFrame:
    return buylist.where(wanted())


def repurchase_candidates(buylist: DataFrame) -> DataFrame:
    return ranked(buylist.where(is_true("bought") & is_true("starred")), ["list_id"], [*down("created_at"), *up("id")])


def wishlist_by_status(buylist: DataFrame, status: str | None = None) -> DataFrame:
    """Listing in the purchased / pending vocabulary, newest first."""
    known = None if status is None else status.strip().lower()
    if known not in (None, "pending", "purchased"):
        raise ValueError(f"status must be pending or purchased, not {status!r}")
    chosen = _of_status(buylist, known).withColumn("status", F.when(flag("bought"), "purchased").otherwise("pending"))
    return ranked(chosen, ["list_id"], [*down("created_at"), *up("id")])


def _of_status(buylist: DataFrame, status: str | None) -> DataFrame:
    if status is None:
        return buylist
    return buylist.where(is_true("bought") if status == "purchased" else not_true("bought"))


def legacy_wishlist(wishlist: DataFrame) -> DataFrame:
    """The older list per user, in sections by status with their sizes."""
    known = wishlist.where(F.col("status").isin("pending", "purchased"))
    keys = ["username", "status"]
    sizes = known.groupBy(*keys).agg(F.count("*").alias("section_size"))
    return ranked(known, keys, up("id")).join(sizes, keys)


def sauces_ranked(sauces: DataFrame, search: str = "") -> DataFrame:
    sought = search.strip().lower()
    chosen = sauces.where(F.lower(F.coalesce("name", F.lit(""))).contains(sought)) if sought else sauces
    return ranked(chosen, ["list_id"], [*down("repurchase", "created_at"), *up("id")])


def urgency_labels(buylist: DataFrame) -> DataFrame:
    return buylist.withColumns(
        {
            "urgency_label": labelled(F.col("urgency"), URGENCY_LABELS, URGENCY_LABELS["maybe"]),
            "access_label": labelled(F.col("accessibility"), ACCESS_LABELS, ACCESS_LABELS["tw_easy"]),
            "public_label": labelled(F.col("urgency"), PUBLIC_URGENCY_LABELS, ""),
        }
    )


def price_difference(buylist: DataFrame) -> DataFrame:
    """For bought items, what was paid against the estimate; blank when not filled in."""
    over = F.col("actual_price") - or_zero(F.col("price"))
    text = (
        F.when(~flag("bought") | F.col("actual_price").isNull(), F.lit(""))
        .when(over == 0, F.lit("持平"))
        .when(over < 0, F.concat(F.lit("省 "), money_text(-over)))
        .otherwise(F.concat(F.lit("超 "), money_text(over)))
    )
    return buylist.withColumn("difference", text)


def days_wanted(buylist: DataFrame, as_of: datetime.datetime) -> DataFrame:
    days = age_days(as_of)
    label = F.when(days <= 0, "今天加入").otherwise(F.concat(F.lit("想買了 "), days.cast("string"), F.lit(" 天")))
    return buylist.withColumn("days", days).withColumn("days_label", label)


def default_order() -> list[Column]:
    """The default order of a list as ascending values."""
    return [
        flag("bought").cast("int").alias("_o_bought"),
        (~active()).cast("int").alias("_o_idle"),
        urgency_rank().alias("_o_urgency"),
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("_o_age"),
        F.col("id").alias("_o_id"),
    ]


def buylist_sort_default(buylist: DataFrame) -> DataFrame:
    order = [flag("bought").asc(), active().desc(), urgency_rank().asc(), F.col("created_at").desc(), F.col("id").asc()]
    return ranked(buylist, ["list_id"], order)


def buylist_sort_price(buylist: DataFrame) -> DataFrame:
    order = [flag("bought").asc(), or_zero(F.col("price")).desc(), *up("created_at", "id")]
    return ranked(buylist, ["list_id"], order)


def buylist_sort_days(buylist: DataFrame, as_of: datetime.datetime) -> DataFrame:
    return ranked(buylist, ["list_id"], [flag("bought").asc(), age_days(as_of).desc(), *up("created_at", "id")])


def budget_status(budget: DataFrame, buylist: DataFrame) -> DataFrame:
    """Month total against the budget of each list; lists on either side are kept."""
    now = F.when(active(), or_zero(F.col("price")))
    later = F.when(active(), or_zero(F.col("recurring_cost")))
    return budget_rows(budget, buylist.groupBy("list_id").agg(exact_sum(now).alias("total"), exact_sum(later).alias("recurring")))


def budget_rows(budget: DataFrame, totals: DataFrame) -> DataFrame:
    """Status of every list of either table from its budget and its ``total`` and ``recurring`` sums."""
    joined = budget.select("list_id", "monthly_budget").join(totals, "list_id", "full")
    zero = F.lit(0).cast("decimal(20,2)")
    limit = F.coalesce(F.col("monthly_budget").cast("decimal(20,2)"), zero)
    total = F.coalesce("total", zero)
    left = (limit - total).cast("decimal(20,2)")
    status = F.when(limit == 0, "none").when(left >= 0, "ok").otherwise("over")
    return joined.select(
        "list_id",
        limit.alias("budget"),
        total.alias("total"),
        F.when(limit != 0, left).alias("remaining"),
        F.when(status == "over", -left).alias("overspend"),
        F.coalesce("recurring", zero).alias("recurring"),
        status.alias("status"),
    )


def category_rollup(visible: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per list and category of the visible items: sizes, unbought sum and display place.

    Known categories come in their fixed order, others by their first item in the
    default order, found as a minimum over just those, so that no item has to be ranked.
    """
    order = order or CATEGORIES
    keys = ["list_id", "category"]
    unbought = ~flag("bought")
    rows = visible.withColumn("category", category())
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("items"),
        F.count_if(unbought).alias("unbought"),
        exact_sum(F.when(unbought, or_zero(F.col("price")))).alias("unbought_sum"),
    )
    others = rows.where(~F.col("category").isin(order))
    first = others.groupBy(*keys).agg(F.min(F.struct(*default_order())).alias("_first"))
    return placed_categories(groups.join(first, keys, "left"), order, hot_keys(visible, ["list_id"]))


def placed_categories(groups: DataFrame, order: list[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Number the categories of each list: those of the fixed order, then the others by ``_first``."""
    order = order or CATEGORIES
    known = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    groups = groups.withColumn("_known", F.nullif(known, F.lit(0).cast("long")))
    place = [F.col("_known").asc_nulls_last(), F.col("_first").asc()]
    placed = ranked(groups, ["list_id"], place, "place", hot)
    return placed.withColumn("all_bought", F.col("unbought") == 0).drop("_first", "_known")


def _with_cell(items: DataFrame) -> DataFrame:
    """Cell of each wanted item: urgent or not, and at or above the upper median price.

    Prices are compared through counts: an item is at or above the median when at least
    ``n div 2 + 1`` prices of its list are not greater than its own.  The median of a hot list is selected by
    counting, and looked up by its rows where they are.
    """
    rows = items.withColumn("_price", or_zero(F.col("price")))
    hot = hot_keys(rows, ["list_id"])
    cold, heavy = hot.split(rows)
    whole = Window.partitionBy("list_id")
    upto = whole.orderBy("_price").rangeBetween(Window.unboundedPreceding, 0)
    out = cold.withColumns(
        {
            "_upto": F.count("*").over(upto),
            "_n": F.count("*").over(whole),
            "_free": F.count_if(F.col("_price") <= 0).over(whole),
        }
    )
    need = F.expr("_n div 2 + 1")
    high = (F.col("_upto") >= need) & (F.col("_free") < need)
    out = out.withColumn("cell", _cell(high)).drop("_price", "_upto", "_n", "_free")
    if heavy is None:
        return out
    medians = nth_values(heavy, "list_id", F.col("_price") * 100, F.expr("n div 2 + 1"), "id").withColumnRenamed("value", "_median")
    found = salted_lookup(heavy, medians.drop("n"), ["list_id"], "id", "inner")
    high = (F.col("_price") * 100 >= F.col("_median")) & (F.col("_median") > 0)
    return out.unionByName(found.withColumn("cell", _cell(high)).drop("_price", "_median"))


def _cell(high: Column) -> Column:
    need = F.when(F.col("urgency").isin("need", "want"), F.lit("-need")).otherwise(F.lit("-low"))
    return F.concat(F.when(high, "hi").otherwise("lo"), need)


def price_urgency_matrix(buylist: DataFrame) -> DataFrame:
    return _with_cell(buylist.where(wanted()))


def matrix_counts(buylist: DataFrame) -> DataFrame:
    """Size and price sum of all four cells of every list."""
    rows = price_urgency_matrix(buylist)
    per_cell = []
    for i, name in enumerate(CELLS):
        here = F.col("cell") == name
        per_cell += [F.count_if(here).alias(f"n{i}"), exact_sum(F.when(here, or_zero(F.col("price")))).alias(f"s{i}")]
    counts = rows.groupBy("list_id").agg(*per_cell)
    lists = buylist.select("list_id").distinct().join(counts, "list_id", "left")
    zero = F.lit(0).cast("decimal(20,2)")
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("cell"),
                F.coalesce(f"n{i}", F.lit(0).cast("long")).alias("items"),
                F.coalesce(f"s{i}", zero).alias("price_sum"),
            )
            for i, name in enumerate(CELLS)
        ]
    )
    return lists.select("list_id", F.inline(cells))


def distinct_tags(buylist: DataFrame) -> DataFrame:
    tags = buylist.select("list_id", trimmed_tag().alias("tag")).where(F.col("tag") != "").distinct()
    return ranked(tags, ["list_id"], up("tag"), hot=hot_keys(buylist, ["list_id"]))


def reset_vanished_tag(buylist: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen tag per list, back to ``all`` when no item carries it any more."""
    tags = buylist.select("list_id", trimmed_tag().alias("tag"), F.lit(True).alias("_seen")).distinct()
    joined = chosen.join(tags, ["list_id", "tag"], "left")
    return joined.select("list_id", F.when(flag("_seen") & (F.col("tag") != ""), F.col("tag")).otherwise("all").alias("tag"))


def tag_unbought_counts(buylist: DataFrame) -> DataFrame:
    return buylist.groupBy("list_id", trimmed_tag().alias("tag")).agg(F.count_if(~flag("bought")).alias("unbought"))


def list_headline(buylist: DataFrame, status: str | None = None) -> DataFrame:
    """Per list: how many items a status listing has and the first three names."""
    known = None if status is None else status.strip().lower()
    newest = -F.unix_micros(F.col("created_at").cast("timestamp"))
    lines = headline(_of_status(buylist, known), ["list_id"], [newest, F.col("id")], F.col("name"))
    count = F.concat(F.lit(f"購物清單{SCOPES[known]}共 "), F.col("n").cast("string"))
    return lines.withColumn("summary", F.concat(count, F.lit(" 筆，例如："), "head", F.lit("。")))


def markdown_totals(buylist: DataFrame) -> DataFrame:
    unbought = F.when(~flag("bought"), or_zero(F.col("price")))
    return buylist.groupBy("list_id").agg(F.count("*").alias("items"), exact_sum(unbought).alias("unbought_total"))


def bulk_add_rows(pastes: DataFrame, added_by: str = "") -> DataFrame:
    """New items from pasted text: one per distinct trimmed name, in order of appearance.

    A paste is one value of one row, so it is cut and deduplicated in place, without a
    shuffle.
    """
    pieces = F.transform(F.split("text", "[\n,、，]+"), js_trim)
    names = F.array_distinct(F.filter(pieces, lambda name: name != ""))
    rows = pastes.select("list_id", F.posexplode(names).alias("pos", "name"))
    return rows.withColumns(
        {
            "price": F.lit(0).cast("decimal(12,2)"),
            "urgency": F.lit("maybe"),
            "accessibility": F.lit("tw_easy"),
            "category": F.lit(DEFAULT_CATEGORY),
            "this_month": F.lit(True),
            "bought": F.lit(False),
            "added_by": F.lit(added_by),
            "note": F.lit(""),
            "link": F.lit(""),
            "recurring_cost": F.lit(0).cast("decimal(12,2)"),
            "quantity": F.lit(1),
        }
    )


def repurchase_copy(buylist: DataFrame, picks: DataFrame, added_by: str, as_of: datetime.datetime) -> DataFrame:
    """Picked starred items as new, not yet bought rows; ``source_id`` names the original."""
    chosen = buylist.where(is_true("bought") & is_true("starred")).join(picks.select("id"), "id", "left_semi")
    return chosen.select(
        F.col("id").alias("source_id"),
        "list_id",
        "name",
        or_zero(F.col("price")).cast("decimal(12,2)").alias("price"),
        text_or(F.col("urgency"), "maybe").alias("urgency"),
        text_or(F.col("accessibility"), "tw_easy").alias("accessibility"),
        F.lit(True).alias("this_month"),
        F.lit(False).alias("bought"),
        F.lit(added_by).alias("added_by"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("link", F.lit("")).alias("link"),
        category().alias("category"),
        or_zero(F.col("recurring_cost")).cast("decimal(12,2)").alias("recurring_cost"),
        F.lit(as_of).alias("created_at"),
        F.lit(False).alias("starred"),
        F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1)).alias("quantity"),
        F.coalesce("tag", F.lit("")).alias("tag"),
        F.lit(None).cast("decimal(12,2)").alias("actual_price"),
    )


def monthly_rollover(budget: DataFrame, buylist: DataFrame, as_of: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """First run of a month: bought items go, and the month is noted on every budget row."""
    month = as_of.astimezone(datetime.timezone.utc) if as_of.tzinfo else as_of
    month_text = month.strftime("%Y-%m")
    cleared = F.coalesce("last_cleared", F.lit(""))
    due = budget.where((cleared != "") & (cleared != month_text)).select("list_id", F.lit(True).alias("_due"))
    kept = buylist.join(due, "list_id", "left").where(~(flag("bought") & flag("_due"))).drop("_due")
    return budget.withColumn("last_cleared", F.lit(month_text)), kept
