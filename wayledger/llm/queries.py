"""The registered queries of this package and, where SQL can express one, the SQL it is checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm import alignment, chat, hosts, language, leaks, near, notices, quality, sharding, structure, topk, toxicity
from wayledger.llm.pieces import Pieces
from wayledger.llm.training import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_sentencepiece")
def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's piece ids, how many of them are byte pieces, and whether decoding gives the text back."""
    model = Pieces(spark)
    coded = table(spark, folder, "documents").select("doc_id", model.checked(F.col("text")).alias("coded"))
    coded = coded.select("doc_id", "coded.ids", "coded.round_trip")
    first, last = min(model.byte_ids), max(model.byte_ids)
    return coded.select(
        "doc_id",
        F.size("ids").alias("n_pieces"),
        F.size(F.filter("ids", lambda i: i.between(first, last))).alias("n_byte_pieces"),
        "round_trip",
        "ids",
    )


@query("op5_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents shuffled into 16 shards of counts at most one apart."""
    documents = table(spark, folder, "documents")
    size = sharding.record_bytes(F.col("text"))
    buckets = sharding.count_buckets(documents, size)
    shuffled = sharding.shuffle_into_shards(documents, ["doc_id", "text"], 16, buckets)
    return shuffled.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_notices")
def licence_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every document: places of the base phrases, labels, and how near the best notice is."""
    documents = table(spark, folder, "documents")
    found = documents.select("doc_id", notices.notice_spans(spark, F.col("text")).alias("found"))
    found = found.select("doc_id", "found.n_words", "found.spans")
    base = F.filter("spans", lambda s: (s.edits == 0) & s.phrase.isin(*notices.BASE))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")

    nearness = F.transform("spans", lambda s: 1 - s.edits / F.length(s.phrase))
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s.first_word)).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s.first_word)).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(nearness), F.lit(0.0)).alias("score"),
        "spans",
    )


def judged(documents: DataFrame, folds: int, held_out: int, score) -> DataFrame:
    """The columns that the queries of trained operators return."""
    # Rows without an id are never learnt from.
    unseen = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(True))
    scored = documents.select("doc_id", unseen.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability of being toxic, learnt from the labels outside fold 0 of 5."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(documents, labels, fold(F.col("doc_id"), 5) != 0)
    return judged(documents, 5, 0, model.score(spark, F.col("text")))


@query("op4_quality")
def good(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability of being of good quality, learnt from the labels outside fold 1 of 3."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(documents, labels, fold(F.col("doc_id"), 3) != 1)
    return judged(documents, 3, 1, model.score(spark, F.col("text")))


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op7_near_duplicates",
    rf"""with recursive words as (
      select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_A_TO_Z}), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
    each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
    pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as shared
      from each a join each b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
    links as (select a, b from pairs where 100 * shared >= 80 * (n_a + n_b - shared)),
    reached as (select doc_id, doc_id as other from documents
      union select r.doc_id, l.b from reached r join links l on l.a = r.other)
    select s.doc_id, any_value(len(s)) as n_shingles, min(other) as component_id, s.doc_id = min(other) as kept
    from sets s join reached r on r.doc_id = s.doc_id group by s.doc_id""",
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of four-word shingle sets that overlap by 80 percent."""
    found = near.near_classes(table(spark, folder, "documents"), forest=near.Forest(words=4))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op1_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The rules that url verdicts begin with.
RULES = [
    hosts.Rule("block", "net", "/"),
    hosts.Rule("allow", "example.net", "/en/"),
    hosts.Rule("block", "example.com", "/de/"),
    hosts.Rule("allow", "org", "/fr/"),
]


@query("op2_url_verdicts")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict by rule or, without one, by the trust and distrust that reach its host."""
    return hosts.judge(table(spark, folder, "pages"), RULES)


_WHOLE = "list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))"


@query(
    "op8_top_k",
    f"""with vectors as (select vec_id, {_WHOLE} as v from embeddings where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scores as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
      from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
    select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 20""",
)
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, 20, 64)


@query("op3_chat_repair")
def chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every conversation after the cheapest repair of its roles, as rendered."""
    return chat.repair(table(spark, folder, "conversations"))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _repair_sql() -> str:
    """Plain recursion over the rows from the last to the first, least cost and least edits from every state."""
    way = lambda state, cost, edit: f"{{'c': {state}.c + {cost}, 'e': '{edit}' || {state}.e}}"
    never = "{'c': 1000000, 'e': ''}"
    extra = "(case when fault = 'truncated' then 5 else 0 end)"
    follows = {"q0": "qu", "qs": "qu", "qu": "qa", "qa": "qu"}
    plain = []
    for state, to in follows.items():
        letter = to[1]
        keeps = f"case when stays and letter = '{letter}' then {way(to, extra, 'K')} else {never} end"
        reroles = f"case when stays then {way(to, '1 + ' + extra, 'R')} else {never} end"
        ways = [way(state, 2, "D"), keeps, reroles]
        if state == "q0":
            ways.append(f"case when stays and letter = 's' then {way('qs', extra, 'K')} else {never} end")
        plain.append(f"{_least(*ways)} as {state}")
    inserted = ", ".join(f"{_least(state, way(to, 5, 'I'))} as {state}" for state, to in follows.items())
    return rf"""with recursive polynomial(byte, bits, code) as (
      select range, 0, range from range(256) union all
      select byte, bits + 1, xor(code >> 1, 3988292384 * (code & 1)) from polynomial where bits < 8),
    crc as (select list(code order by byte) as codes from polynomial where bits = 8),
    named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
      coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
    fated as (select named.* exclude (key), xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: cast(unicode(x) as bigint))),
        lambda c, b: xor(codes[(xor(c, b) & 255) + 1], c >> 8))) % 20 as fate from named, crc),
    damaged as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
      case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
      unnest(case when fate = 3 then [0, 1] else [0] end) as copy from fated where fate <> 0),
    placed as (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
      row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from damaged),
    faults as (select *, left(role, 1) as letter, case when body = '' then 'blank'
      when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
      when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
      lag(left(role, 1)) over (partition by conv_id order by pos) as before from placed),
    sizes as (select conv_id, count(*) as n from faults group by conv_id),
    paths as (select conv_id, n as pos, {{'c': 0, 'e': ''}} as q0, {{'c': 10, 'e': 'II'}} as qs, {{'c': 5, 'e': 'I'}} as qu,
        {{'c': 0, 'e': ''}} as qa from sizes
      union all
      select conv_id, pos, {inserted} from (select conv_id, pos, {inserted} from (
        select f.conv_id, f.pos - 1 as pos, {", ".join(plain)} from (select p.*, letter, fault,
          fault not in ('blank', 'duplicate') as stays, f.pos as row_at from paths p join faults f
          on f.conv_id is not distinct from p.conv_id and f.pos = p.pos) as f) as one) as two),
    best as (select conv_id, q0.c as cost, q0.e as audit from paths where pos = 0),
    letters as (select conv_id, audit, unnest(string_split(audit, '')) as edit, unnest(range(1, length(audit) + 1)) as i
      from best where audit <> ''),
    steps as (select *, count(*) filter (edit <> 'I') over w as pos, count(*) filter (edit <> 'D') over w as out
      from letters window w as (partition by conv_id order by i)),
    output as (select s.conv_id, s.i, s.edit, s.out, f.role, f.text,
        bool_or(s.out = 1 and s.edit = 'K' and f.letter = 's') over (partition by s.conv_id) as opens
      from steps s left join faults f on f.conv_id is not distinct from s.conv_id and f.pos = s.pos and s.edit <> 'I'
      where s.edit <> 'D'),
    lines as (select conv_id, i, case when edit = 'K' then role when (out - cast(opens as int)) % 2 = 1 then 'user'
      else 'assistant' end || ':' || case when edit = 'I' then '' else text end as line from output),
    digests as (select conv_id, sha256(string_agg(line, chr(10) order by i)) as digest from lines group by conv_id),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
      count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
      count(*) filter (fault = 'truncated') as truncated,
      count(*) filter (before is not null and before || letter not in ('su', 'ua', 'au')) as illegal
      from faults group by conv_id),
    ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
      coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
      coalesce(audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
    from ids left join counts on counts.conv_id is not distinct from ids.conv_id
      left join best on best.conv_id is not distinct from ids.conv_id
      left join digests on digests.conv_id is not distinct from ids.conv_id"""


@query("op13_structure_repair", _repair_sql())
def structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The faults of every damaged conversation, its cheapest edits and the digest of the repaired rows."""
    conversations = table(spark, folder, "conversations")
    return structure.report(conversations, structure.damage(conversations))


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every document."""
    return alignment.report(alignment.aligned(table(spark, folder, "documents")))


@query("op12_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language by its words, learnt from the documents outside fold 0 of 5."""
    documents = table(spark, folder, "documents")
    model = language.train(documents, fold(F.col("doc_id"), 5) != 0)
    found = documents.select("doc_id", model.predict(spark, F.col("text")).alias("found"))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return found.select("doc_id", held_out, F.col("found.lang").alias("lang_pred"), "found.score", "found.n_words")
