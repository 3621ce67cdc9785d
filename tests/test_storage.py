"""Posting lists, bucketed tables, document files and raw text against scans, full rewrites and literal rows."""

import glob
import os
import pickle
import random

import pyarrow as pa
import pytest
from checking import new_shuffle_bytes, shuffle_files
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayledger.operators import changes, search, shopping
from wayledger.session import checkpointed
from wayledger.sources import documents, raw
from wayledger.sources.buckets import BucketedTable
from wayledger.sources.fixtures import Tables


def test_search_finds_what_a_scan_finds(spark):
    draw = random.Random(4)
    letters = "ab %_éŞ漢"
    text = lambda size: None if draw.random() < 0.1 else "".join(draw.choice(letters) for _ in range(draw.randrange(size)))
    rows = [(i, i % 5, text(9), text(6), text(4), text(4)) for i in range(300)] + [(999, 1, None, None, None, None)]
    items = spark.createDataFrame(rows, "id long, list_id long, name string, note string, tag string, category string")
    texts = ["", " ", "a", "A%", "b_", "aba", " ab ", "éş", "漢", "ba%a", "abab", "zzz", "a" * 40, None, "É"]
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    found = search.search(items, search.build_index(items), searches)
    got = {}
    for r in found.collect():
        got.setdefault(r.search_id, []).append(r.id)
    for number, sought in enumerate(texts):
        scan = [r.id for r in shopping.buylist_visible(items, search=sought or "").collect()]
        assert sorted(got.get(number, [])) == sorted(scan), sought
    assert search.search(items, search.build_index(items), searches.where("false")).count() == 0
    assert search.search(items.where("false"), search.build_index(items.where("false")), searches).count() == 0


def test_an_index_is_read_by_its_grams(spark, folder, tmp_path):
    """The lookup is an equality join on grams, and items are met by id: no search meets every item."""
    items = Tables(spark, folder).buylist_items
    search.write_index(search.build_index(items), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    searches = items.select(F.col("id").alias("search_id"), F.substring("name", 1, 6).alias("text"))
    plan = search.search(items, index, searches)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def files_of(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/bucket=*/*.parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, folder, tmp_path):
    items = Tables(spark, folder).items
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 500)
    table.create(items)
    before = files_of(table.folder)
    patches = items.orderBy("id").limit(100).select(F.col("id").alias("item_id"), F.lit("changed").alias("notes"))
    touched = table.apply(patches.select(F.col("item_id").alias("id")), lambda rows: changes.patch_items(rows, patches))
    after = files_of(table.folder)
    changed = {p.split("bucket=")[1].split("/")[0] for p in before.keys() ^ after.keys()}
    assert len(changed) == len(touched) <= 100
    assert all(after[p] == stamp for p, stamp in before.items() if p in after)
    want, columns = changes.patch_items(items, patches), [c for c in items.columns if c != "created_at"]
    assert sorted(table.read().select(*columns).collect(), key=str) == sorted(want.select(*columns).collect(), key=str)


def test_emptied_buckets_and_repeated_publishing(spark, folder, tmp_path, monkeypatch):
    items = Tables(spark, folder).items
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 4)
    table.create(items)
    gone = items.select("id").where(F.pmod(F.xxhash64("id"), F.lit(4)) == 2)
    assert table.apply(gone, lambda rows: changes.delete_rows(rows, gone)) == [2]
    assert not os.path.exists(f"{table.folder}/bucket=2")
    left = changes.delete_rows(items, gone)
    assert table.read().count() == left.count() < items.count()
    assert table.apply(gone.limit(0), lambda rows: rows) == []

    # Staged rows outlive an interrupted publishing and are put in place by another.
    taken, publish = [], BucketedTable.publish
    monkeypatch.setattr(BucketedTable, "publish", lambda self, *args: taken.append(args))
    ids = left.select("id").limit(30)
    table.apply(ids, lambda rows: changes.delete_rows(rows, ids))
    assert table.read().count() == left.count()
    publish(table, *taken[0])
    assert table.read().count() == left.count() - 30


def test_staged_files_are_moved(spark, folder, tmp_path, monkeypatch):
    """Publishing writes no row again, and may be done in part or once more."""
    items = Tables(spark, folder).items
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 4)
    table.create(items)
    gone = items.select("id").where(F.pmod(F.xxhash64("id"), F.lit(4)).isin(1, 2) & ((F.col("id") % 2 == 0) | (F.pmod(F.xxhash64("id"), F.lit(4)) == 1)))
    taken, publish = [], BucketedTable.publish
    monkeypatch.setattr(BucketedTable, "publish", lambda self, *args: taken.append(args))
    table.apply(gone, lambda rows: changes.delete_rows(rows, gone))
    staged, touched = taken[0]
    assert touched == [1, 2] and table.read().count() == items.count()
    written = {os.path.basename(p) for p in glob.glob(f"{staged}/rows/bucket=2/*.parquet")}

    class Stopped(Exception):
        pass

    def stopped(*args):
        raise Stopped

    # Stopped when all is moved and only the staged folder is left.
    monkeypatch.setattr("wayledger.sources.buckets.remove", stopped)
    with pytest.raises(Stopped):
        publish(table, staged, touched)
    monkeypatch.undo()
    left = changes.delete_rows(items, gone).count()
    for _ in range(2):
        assert {os.path.basename(p) for p in glob.glob(f"{table.folder}/bucket=2/*.parquet")} == written
        assert not os.path.exists(f"{table.folder}/bucket=1") and table.read().count() == left
        publish(table, staged, touched)
    assert not os.path.exists(staged)


ITEM = "id long, trip_id long, name string, day_number int, start_time string, sort_order int"


@pytest.mark.parametrize("together", [1, 40, 10_000])
def test_requests_some_buckets_at_a_time(spark, tmp_path, together):
    """Broadcast together or joined alone, a batch gives what the whole table gives, rows repeated or without id too."""
    rows = [(i % 150 if i % 7 else None, i, f"n{i}", i % 3, "09:00", i) for i in range(400)]
    items = spark.createDataFrame(rows, ITEM)
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 8)
    table.create(items)
    read = lambda: sorted(table.read().select(*items.columns).collect(), key=str)
    asked = [(i // 2 if i % 9 else None, i, "changed" if i % 3 else None) for i in range(350)]
    patches = spark.createDataFrame(asked, "item_id long, sort_order int, name string")
    want = changes.patch_items(items, patches)
    assert table.apply_requests(patches, changes.patch_items, "item_id", together) == list(range(8))
    assert read() == sorted(want.select(*items.columns).collect(), key=str)
    gone = patches.where("sort_order < 60 or pmod(xxhash64(item_id), 8) = 3").select(F.col("item_id").alias("id"))
    want = changes.delete_rows(want, gone)
    table.apply_requests(gone, changes.delete_rows, together=together)
    assert read() == sorted(want.select(*items.columns).collect(), key=str)
    before = files_of(table.folder)
    assert table.apply_requests(gone.where("id is null"), changes.delete_rows) == [] and files_of(table.folder) == before
    assert not glob.glob(f"{table.folder}/_staged-*")


def test_rows_stay_with_the_tasks_that_read_them(spark, folder, tmp_path):
    """Few requests of some buckets are broadcast however large a table Spark takes them for; the rows meet no shuffle."""
    items = Tables(spark, folder).items
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 4)
    table.create(items)
    option, plans = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(option)

    def planned(change):
        def made(rows, part):
            plans.append((changed := change(rows, part))._jdf.queryExecution().executedPlan().toString())
            return changed

        return made

    ids = items.where("confirm_required").select("id")
    spark.conf.set(option, "-1")
    try:
        for change in (changes.unschedule_items, changes.delete_rows):
            table.apply_requests(ids, planned(change))
    finally:
        spark.conf.set(option, before)
    assert len(plans) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    assert "hashpartitioning" not in plans[1] and plans[0].count("hashpartitioning") == 1
    assert table.read().count() == changes.delete_rows(items, ids).count()


def test_long_requests_are_broadcast_in_smaller_groups(spark, tmp_path):
    """What is broadcast is bounded by its texts too."""
    items = spark.range(80).selectExpr("id", "id as trip_id", "'n' as name")
    table = BucketedTable(spark, str(tmp_path / "items"), "itinerary_items", 4)
    table.create(items)
    met = []

    def change(rows, part):
        met.append(part.count())
        return changes.patch_items(rows, part)

    for text, groups in (("x", 1), ("x" * 99, 1), ("x" * 300, 4)):
        patches = items.select(F.col("id").alias("item_id"), F.lit(text).alias("notes"))
        table.apply_requests(patches, change, "item_id", 80)
        assert len(met) == groups and sum(met) == 80
        assert {tuple(r) for r in table.read().select("notes").collect()} == {(text,)}
        met.clear()


@pytest.mark.parametrize("name", ["unschedule_items_in_buckets", "delete_rows_in_buckets", "ics_files"])
def test_stored_forms_leave_no_shuffle_files(spark, tmp_path, name):
    """Nothing but the table or the files is left for the reading: what was written isn't kept in shuffles too, only counts are."""
    spark.range(400).selectExpr(
        "id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "1.0D as o_totalprice",
        "timestamp_ntz'1995-01-01 00:00:00' as o_orderdate", "'5-LOW' as o_orderpriority",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(4_000).selectExpr(
        "id % 400 as l_orderkey", "id * 7 as l_partkey", "id as l_suppkey", "cast(id % 5 as int) as l_linenumber", "1.0D * id as l_quantity",
        "1.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "if(id % 3 = 0, 'A', 'R') as l_returnflag", "'F' as l_linestatus",
        "timestamp_ntz'1995-02-01 00:00:00' as l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = shuffle_files(spark)
    made = entry.queries()[name](spark, str(tmp_path))
    assert new_shuffle_bytes(spark, before, 30_000) <= 30_000
    assert made.count() > 0


def test_documents_are_whole_files(spark, tmp_path):
    rows = [(k, part, f"{k}:{part}\n") for k in ("1", "a/b c", "ü%41") for part in range(50)] + [("empty", 0, "")]
    random.Random(1).shuffle(rows)
    parts = spark.createDataFrame(rows, "name string, part int, body string")
    folder = str(tmp_path / "out")
    os.mkdir(folder)
    documents.write_documents(parts, F.col("name"), folder, ".txt")
    found = {r.key: r.body for r in documents.read_documents(spark, folder, ".txt").collect()}
    assert found == {k: "".join(f"{k}:{p}\n" for p in range(50)) for k in ("1", "a/b c", "ü%41")}
    assert len(os.listdir(folder)) == 4 and os.path.getsize(f"{folder}/empty.txt") == 0
    # Written again, a document replaces its file and leaves the others.
    documents.write_documents(spark.createDataFrame([("1", 0, "new")], parts.schema), F.col("name"), folder, ".txt")
    found = {r.key: r.body for r in documents.read_documents(spark, folder, ".txt").collect()}
    assert found["1"] == "new" and len(found) == 3


def test_documents_in_folders(spark, tmp_path):
    """The same files, dealt over sub-folders; nothing on the driver grows with their number."""
    rows = [(k, part, f"{k}:{part}\n") for k in ("1", "a/b c", "ü%41", "_x") for part in range(9)] + [("empty", 0, None), (None, 0, "n")]
    random.Random(1).shuffle(rows)
    parts = spark.createDataFrame(rows, "name string, part int, body string")
    folder = str(tmp_path / "out")
    documents.write_documents(parts, F.col("name"), folder, ".txt", folders=3)
    found = lambda: sorted(map(tuple, documents.read_documents(spark, folder, ".txt", 3).collect()))
    want = {k: "".join(f"{k}:{p}\n" for p in range(9)) for k in ("1", "a/b c", "ü%41", "_x")} | {"None": "n"}
    assert found() == sorted(want.items())
    assert set(os.listdir(folder)) <= {"0", "1", "2"} and len(glob.glob(f"{folder}/*/*.txt")) == 6
    # Written again into folders that are there, a document replaces its file and leaves the others.
    documents.write_documents(spark.createDataFrame([("1", 0, "new")], parts.schema), F.col("name"), folder, ".txt", folders=3)
    assert found() == sorted((want | {"1": "new"}).items())
    plan = documents.read_documents(spark, folder, ".txt", 3)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_what_a_task_reports_has_one_length(tmp_path):
    lengths = []
    for number in (1, 300):
        keys = [str(k) for k in range(number)]
        batch = pa.RecordBatch.from_pydict({"key": keys, "part": [0] * number, "body": keys})
        writer = documents.DocumentWriter(f"file://{tmp_path}/out{number:03}", ".txt")
        message = writer.write(iter([batch]))
        lengths.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert len(os.listdir(tmp_path / f"out{number:03}")) == number
    assert lengths[0] == lengths[1]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    parts = spark.range(200).selectExpr("id as name", "0 as part", "if(id = 150, raise_error('broken'), 'x') as body")
    with pytest.raises(PySparkException):
        documents.write_documents(parts.repartition(8, "name"), F.col("name"), folder, ".txt")
    assert not os.path.exists(folder) or os.listdir(folder) == []


JSON = [
    ('{"id": 1, "username": "u", "name": "n", "start_date": "2025-01-01", "end_date": "2025-01-02", "extra": {"a": [1]}}', None),
    ('{"id": 2, "username": "u", "name": "cut', "unreadable"),
    ("[]", "unreadable"),
    ("null", "unreadable"),
    ("plain words", "unreadable"),
    ('{"id": "x", "username": "u", "name": "n", "start_date": "2025-01-01", "end_date": "2025-01-02"}', "wrong_type:id"),
    ('{"id": 3, "name": "n", "start_date": "2025-01-01", "end_date": "2025-01-02"}', "missing_required:username"),
    ('{"id": 4, "username": "u", "name": "n", "start_date": "2025-13-01", "end_date": "2025-01-02"}', "wrong_type:start_date"),
    ('{"id": 5, "username": "u", "name": "n", "start_date": "2025-01-01", "end_date": "2025-01-02", "created_at": "2025-01-01 10:00:00"}', None),
    ("{}", "missing_required:username"),
]


def test_json_lines(spark, tmp_path):
    (tmp_path / "raw.json").write_text("\n".join(line for line, _ in JSON) + "\n\n")
    loaded = raw.read_json_lines(spark, str(tmp_path / "raw.json"), "trips")
    assert sorted(r.id for r in loaded.rows.collect()) == [1, 5]
    assert {(r.raw, r.reason) for r in loaded.quarantine.collect()} == {(line, why) for line, why in JSON if why}
    counts = {r.reason: r.n for r in raw.by_reason(loaded).collect()}
    assert sum(counts.values()) == len(JSON) and counts["ok"] == 2
    assert loaded.rows.schema == Tables(spark, "/root/testdata/sf0.001").trips.schema or loaded.rows.dtypes[0] == ("id", "bigint")


def test_csv_lines(spark, tmp_path):
    lines = [
        "list_id,monthly_budget,last_cleared", "1,10.50,2025-01", "2,much,2025-01", "3,5", "4,5,2025-01,more", ",7,2025-02",
        '5,1.00,"a ""quoted"", cell"',
    ]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    loaded = raw.read_csv_lines(spark, str(tmp_path / "raw.csv"), "buylist_budget")
    rows = {(r.list_id, str(r.monthly_budget), r.last_cleared) for r in loaded.rows.collect()}
    assert rows == {(1, "10.50", "2025-01"), (5, "1.00", 'a "quoted", cell')}
    reasons = {r.raw: r.reason for r in loaded.quarantine.collect()}
    assert reasons == {
        "2,much,2025-01": "wrong_type:monthly_budget", "3,5": "unreadable", "4,5,2025-01,more": "unreadable",
        ",7,2025-02": "missing_required:list_id",
    }
    assert sum(r.n for r in raw.by_reason(loaded).collect()) == 6


def test_checkpointed_leaves_no_shuffle_files(spark):
    """The rows lie in the shared folder alone; what is run without it keeps its files, and can be run again."""
    wanted = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).agg(F.sum("id").alias("total"))
    want, before, option = [(k, sum(range(k, 10_000, 100))) for k in range(100)], shuffle_files(spark), spark.conf.get(wanted)
    kept = checkpointed(rows)
    assert new_shuffle_bytes(spark, before, 0) == 0
    for table in (kept, rows, checkpointed(rows), rows):
        assert sorted(map(tuple, table.collect())) == want
    assert spark.conf.get(wanted) == option
    # A failed run leaves the option as it was, too.
    with pytest.raises(PySparkException):
        checkpointed(spark.range(3).select(F.raise_error(F.lit("broken")).alias("key")))
    assert spark.conf.get(wanted) == option
