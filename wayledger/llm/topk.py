"""Exact inner-product search over integer vectors by an impact-ordered index.

The vectors are spread over shards of bounded size.  A shard's postings (vector, dimension, value) are kept in segments
by quantised impact, the bit length of the value's size.  A block of queries is scored against a shard segment by
segment, highest impact first, the first ones together.  After each the sum so far, plus or minus what the vector's unread values can add (at
most the product of the lengths of the query and of the unread part), bounds every score.  Reading stops once the
bounds prove that few vectors can still be among the k best; those are scored exactly, ties included, and the shards'
best are merged.

Vectors that are null or empty, hold a null or a value that is no finite number, or have a null id take no part.
Shorter vectors count as padded with zeros.  A repeated (id, vector) row counts once; rows with the query's own id are
not its candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayledger.session import checkpointed

SHARD_ROWS = 3_000
BLOCK_ROWS = 2_000
#: Queries scored at once.
SLICE = 256
#: Proof is not tried before the unread values hold at most this part of the vectors' squared lengths.
UNREAD = 0.1
#: Reading stops when so many times k vectors per query are left.
LEFT = 4

_SEGMENT = pa.struct([("level", pa.int32()), ("slots", pa.binary()), ("dims", pa.binary()), ("values", pa.binary())])
_SHARD = "shard int, ids binary, width int, segments array<struct<level:int,slots:binary,dims:binary,values:binary>>"
_BLOCK = "block int, query_ids binary, query_width int, matrix binary"
_HITS = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part, as doubles."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        lists.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard of (id, vector): its ids and its posting segments, highest impact first."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))

    def indexed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        matrix = _matrix(rows["vector"])
        slots, dims = np.nonzero(matrix)
        values = matrix[slots, dims]
        levels = np.frexp(np.abs(values).astype(float))[1]
        segments = []
        for level in sorted(set(levels.tolist()), reverse=True):
            at = levels == level
            packed = (slots[at].astype("<i4"), dims[at].astype("<i4"), values[at].astype("<i8"))
            segments.append({"level": level} | dict(zip(("slots", "dims", "values"), (x.tobytes() for x in packed), strict=True)))
        ids = rows["id"].to_numpy().astype("<i8").tobytes()
        arrays = [rows["shard"].slice(0, 1), pa.array([ids], pa.binary()), pa.array([matrix.shape[1]], pa.int32())]
        return pa.Table.from_arrays([*arrays, pa.array([segments], pa.list_(_SEGMENT))], ["shard", "ids", "width", "segments"])

    shard = F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard")
    return vectors.select(shard, "id", "vector").groupBy("shard").applyInArrow(indexed, _SHARD)


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    def packed(rows: pa.Table) -> pa.Table:
        matrix = _matrix(rows["vector"])
        arrays = [rows["block"].slice(0, 1), pa.array([rows["id"].to_numpy().astype("<i8").tobytes()], pa.binary())]
        arrays += [pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.astype("<i8").tobytes()], pa.binary())]
        return pa.Table.from_arrays(arrays, ["block", "query_ids", "query_width", "matrix"])

    block = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block")
    return queries.select(block, "id", "vector").groupBy("block").applyInArrow(packed, _BLOCK)


def best_in_shard(ids: np.ndarray, segments: list[dict], width: int, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query number, slot, score) of each query's k best in a shard, at least; ties at the end are all there."""
    width = max(width, queries.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    whole = np.zeros((len(ids), width), np.int64)
    parts = []
    for segment in segments:
        slots, dims = np.frombuffer(segment["slots"], "<i4"), np.frombuffer(segment["dims"], "<i4")
        values = np.frombuffer(segment["values"], "<i8")
        whole[slots, dims] = values
        parts.append((slots, dims, values))
    # Sums of products stay whole numbers in the fastest type that holds them.
    largest = np.abs(queries).astype(float).sum(1).max(initial=0) * np.abs(whole).astype(float).max(initial=0)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    out = []
    for low in range(0, len(queries), SLICE):
        some = queries[low : low + SLICE]
        own = query_ids[low : low + SLICE, None] == ids[None, :]
        lengths = np.sqrt((some.astype(float) ** 2).sum(1))
        sums = np.zeros((len(some), len(ids)), kind)
        unread = (whole.astype(float) ** 2).sum(1)
        possible = ~own
        all_of_it, part = unread.sum(), np.zeros((width, len(ids)), kind)
        for number, (slots, dims, values) in enumerate(parts, 1):
            part[dims, slots] = values
            unread -= np.bincount(slots, values.astype(float) ** 2, len(ids))
            # While much is unread nothing can be proven, so segments are read on and scored together.
            if unread.sum() > UNREAD * all_of_it and number < len(parts):
                continue
            sums += some.astype(kind) @ part
            part[:] = 0
            if len(ids) <= k:
                continue
            # A little more than the exact bound, for the rounding of the roots.
            slack = lengths[:, None] * np.sqrt(np.maximum(unread, 0))[None, :] * (1 + 1e-9) + 1e-6
            least = np.where(own, -np.inf, sums - slack)
            proven = np.partition(least, len(ids) - k, 1)[:, len(ids) - k]
            possible = (sums + slack >= proven[:, None]) & ~own
            if possible.sum() <= LEFT * k * len(some):
                break
        rows, slots = np.nonzero(possible)
        exact = np.empty(len(rows), np.int64)
        for start in range(0, len(rows), 100_000):
            at = slice(start, start + 100_000)
            exact[at] = np.einsum("ij,ij->i", some[rows[at]], whole[slots[at]])
        order = np.lexsort((ids[slots], -exact, rows))
        rows, slots, exact = rows[order], slots[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        out.append((rows[keep] + low, slots[keep], exact[keep]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query (id, vector), ties to the smaller id."""
    queries = queries.distinct()
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def scored(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
                matrix = np.frombuffer(row["matrix"], "<i8").reshape(len(query_ids), row["query_width"])
                which, slots, scores = best_in_shard(ids, row["segments"], row["width"], query_ids, matrix, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[which]), pa.array(ids[slots]), pa.array(scores)], ["query_id", "vec_id", "score"]
                )

    # Every shard meets every block of the stated queries, each meeting by itself in some task.
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = _blocks(queries, blocks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    hits = asked.join(asking, ["shard", "block"]).mapInArrow(scored, _HITS)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int, scale: int) -> DataFrame:
    """Search all vectors, as whole numbers floor(scale * x), for those whose id ``is_query`` (a condition on ``id``)."""
    rows = usable(vectors, id_column, vector_column).select("id", scaled(F.col("vector"), scale).alias("vector")).distinct()
    rows = checkpointed(rows)
    return search(checkpointed(build_index(rows)), rows.where(is_query), k)
