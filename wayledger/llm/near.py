"""Near-duplicate classes of texts by an LSH forest, confirmed on full shingle sets.

Words are what stands between ASCII white space after A-Z are lower-cased; a text's set is its distinct shingles of
some words (64-bit hashes of them), or the whole sequence if it has fewer words.  Texts without words are linked with
nothing.  Texts with equal sets form a class, which goes on as one entry.

The forest has several orders of the classes, each by a different part of one MinHash signature, most significant
value first.  Classes whose signatures share a prefix lie next to each other in an order; from how many values on they
are compared follows from how crowded the region is.  The first pass compares direct neighbours, whose common prefix
is the longest, in every order and joins what is confirmed into components; a region that has become one component
costs nothing more however many copies it holds.  The second pass takes the regions that hold several components: all
classes with a common prefix of ``least_prefix`` values, some orders at a time.  In a region the exact overlaps of all full
sets are counted through an inverted index.  Larger regions are dealt to cells of bounded size, where each pair of
classes of different components meets once; a cell gets each set once and gives only links that join components, so what
is written grows with the sets and not with the pairs.  Between the rounds the components are contracted.

Like any MinHash forest it finds a pair at the threshold with high probability, not certainty (the tests measure it
against all pairs); what it links is exact.

Null ids are possible: a class whose ids are all null has a null component.  Repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches
from wayledger.llm.graph import components, hot_values, lookup
from wayledger.session import checkpointed, forget


@dataclass(frozen=True)
class Forest:
    """``orders`` of ``depth`` signature values each, starting ``stride`` values apart."""

    words: int = 5
    percent: int = 80
    orders: int = 12
    stride: int = 4
    depth: int = 12
    least_prefix: int = 3
    #: Orders compared between two contractions.
    round_orders: int = 6
    #: Sets of a region, or of a group of its classes, that are compared in one task, about.
    cell_bytes: int = 4 << 20
    #: What a set counts for besides its shingles, which bounds the sets of a cell.
    set_bytes: int = 2_048
    #: Rows of an order in one task, at least about; neighbours are at most one task away.
    task_rows: int = 10_000

    @property
    def values(self) -> int:
        return self.orders * self.stride


_WORD_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Sets that ask at once in a cell; shingles that more than one in so many sets hold are counted by matrices.
_ASKERS, _OFTEN = 256, 16
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(hashes))
    # Shorter sequences are told apart from shingles by their width.
    code = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        code = _mixed(code * _WORD_STEP + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(code)


def signature(hashes: np.ndarray, values: int, seed: int = 1) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 63, values, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, values, np.uint64)
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[low : low + 2048, None] * factors + shifts).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def sketches(documents: DataFrame, id_column: str, text_column: str, forest: Forest) -> DataFrame:
    """(id, n_shingles, class, signature); the class is a 128-bit hash of the set, null for texts without words."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, signatures = [], [], []
            for text in batch["text"]:
                found = shingle_set(text.as_py(), forest.words)
                sizes.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found, forest.values).tobytes() if len(found) else None)
            arrays = [batch["id"], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "class", "signature"])

    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(sketched, "id long, n_shingles long, class binary, signature binary")


def _by_order(classes: DataFrame, forest: Forest, extra: list[str], trees: Iterable[int] | None = None) -> DataFrame:
    """One row per order (or some of them) and class with the signature from that order's start."""
    tree = F.explode(F.array(*[F.lit(t) for t in (range(forest.orders) if trees is None else trees)])).alias("tree")
    rows = classes.select(tree, "class", *extra, F.concat("signature", "signature").alias("twice"))
    key = F.expr(f"substring(twice, tree * {4 * forest.stride} + 1, {4 * forest.depth})").alias("key")
    return rows.select("tree", key, "class", *extra)


def _neighbours(classes: DataFrame, forest: Forest) -> DataFrame:
    """Direct neighbours in the sorted orders that share the least prefix, as pairs (a, b) of classes with a < b.

    Neighbours that lie in two tasks meet in a second step: the last row of one task and the first of the next.
    """
    most = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(classes.count() * forest.orders // forest.task_rows, most))
    by = ["tree", "key", "class"]
    ordered = _by_order(classes, forest, ["n_shingles"]).repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    prefix = 4 * forest.least_prefix

    def paired(batches):
        task, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("tree", "key", "class", "n_shingles")), strict=True))
            if not rows:
                continue
            out = [(None, None, None, task - 1, *rows[0])] if last is None else []
            for one, two in zip([last, *rows] if last else rows, rows if last else rows[1:]):
                if one[0] == two[0] and one[1][:prefix] == two[1][:prefix]:
                    out.append((*sorted((one[2], two[2])), _fits(one[3], two[3], forest), *[None] * 5))
            last = rows[-1]
            yield _pair_batch(out)
        if last is not None:
            yield _pair_batch([(None, None, None, task, *last)])

    found = checkpointed(ordered.mapInArrow(paired, _PAIRED))

    def met(edge: pa.Table) -> pa.Table:
        rows = sorted(zip(*(edge[c].to_pylist() for c in ("tree", "key", "class", "n_shingles")), strict=True))
        out = [
            (*sorted((one[2], two[2])), _fits(one[3], two[3], forest))
            for one, two in zip(rows, rows[1:])
            if one[0] == two[0] and one[1][:prefix] == two[1][:prefix]
        ]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES[:3])], ["a", "b", "fits"])

    # Two rows of each edge between tasks.
    edges = found.where("edge is not null").select("edge", "tree", "key", "class", "n_shingles")
    inner = found.where("edge is null").select("a", "b", "fits")
    return inner.unionByName(edges.groupBy("edge").applyInArrow(met, "a binary, b binary, fits boolean"))


_PAIRED = "a binary, b binary, fits boolean, edge long, tree int, key binary, class binary, n_shingles long"
_TYPES = [pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["a", "b", "fits", "edge", "tree", "key", "class", "n_shingles"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names)


def _fits(one: int, two: int, forest: Forest) -> bool:
    """Whether set sizes allow the threshold."""
    return 100 * min(one, two) >= forest.percent * max(one, two)


def _cells(placed: DataFrame, trees: list[int], forest: Forest) -> DataFrame:
    """(cell, side, class, component) of the regions of some orders that hold several components.

    A region of up to ``cell_bytes`` of sets is one cell.  Of a larger one the component with most bytes and the others are
    dealt to groups of about that size by a hash of the class.  Two groups meet in a cell, unless both are of the largest
    component; so each pair of classes of different components meets once, and a set goes to as many cells as there are
    groups that it must meet.  Side 0 meets side 1, and in a cell of one group everything meets.
    """
    name = F.xxhash64("tree", F.substring("key", 1, 4 * forest.least_prefix)).alias("region")
    cost = (forest.set_bytes + 8 * F.col("n_shingles")).alias("bytes")
    rows = _by_order(placed, forest, ["component", "n_shingles"], trees).select(name, "class", "component", cost)
    held = rows.groupBy("region", "component").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    regions = held.groupBy("region").agg(
        F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"),
        F.max_by("component", F.struct("bytes", "component")).alias("major"),
    )
    regions = checkpointed(regions.where("components > 1").drop("components"))
    hot = hot_values(regions, "region", placed.count() * len(trees))
    met = lookup(rows.drop("bytes"), "region", regions.drop("n"), hot).where("bytes is not null")
    # Regions are many and small; few need more than one cell.
    single = F.struct("region", F.lit(0).alias("i"), F.lit(-1).alias("j")).alias("cell")
    whole = met.where(F.col("bytes") <= forest.cell_bytes).select(single, F.lit(-1).alias("side"), "class", "component")
    if regions.where(F.col("bytes") > forest.cell_bytes).isEmpty():
        return whole
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / forest.cell_bytes)).cast("int")
    met = met.where(F.col("bytes") > forest.cell_bytes)
    met = met.select("region", "class", "component", parts(F.col("bytes") - F.col("most")).alias("minor"), parts(F.col("most")).alias("major_parts"), "major")
    is_major = F.col("component") == F.col("major")
    group = F.pmod(F.xxhash64("class"), F.when(is_major, F.col("major_parts")).otherwise(F.col("minor"))).cast("int").alias("group")
    met = met.select("region", "class", "component", "minor", "major_parts", is_major.alias("is_major"), group)
    # Groups of the largest component are numbered after the others.
    others = F.sequence(F.lit(0), F.col("minor") - 1)
    every = F.sequence(F.lit(0), F.col("minor") + F.col("major_parts") - 1)
    met = met.withColumn("own", F.when(F.col("is_major"), F.col("minor") + F.col("group")).otherwise(F.col("group")))
    met = met.withColumn("other", F.explode(F.when(F.col("is_major"), others).otherwise(every)))
    own, other = F.col("own"), F.col("other")
    cell = F.struct("region", F.least(own, other).alias("i"), F.greatest(own, other).alias("j")).alias("cell")
    side = F.when(own == other, -1).when(own < other, 0).otherwise(1).alias("side")
    return whole.unionByName(met.select(cell, side, "class", "component"))


def links_in_cell(components: list[bytes], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs of components that a pair of sets links, as many as it takes to join what hangs together.

    Sets of side 0 are compared with those of side 1, sets of side -1 with all others.  The component with most sets asks
    for none of its own, as any pair of two components has a set of another one.  The overlaps of some sets with all
    others are counted at once: shingles that many sets hold by a product of matrices, the others through an inverted
    index.  No pair is written.
    """
    names, of = np.unique(np.array(components, object), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    side = np.array(sides)
    if side[0] >= 0:
        # The side with more sets is indexed, the other one asks.
        asking = int(np.count_nonzero(side == 0) > np.count_nonzero(side == 1))
        askers, indexed = np.flatnonzero(side == asking), np.flatnonzero(side != asking)
    else:
        askers, indexed = np.flatnonzero(of != np.bincount(of).argmax()), np.arange(len(sets))
    if not len(askers) or not len(indexed):
        return []
    values, column, held = np.unique(np.concatenate([sets[i] for i in indexed]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(indexed)), sizes[indexed])
    often = held > max(len(indexed) // _OFTEN, 8)
    place = np.cumsum(often) - 1
    common = often[column]
    matrix = np.zeros((len(indexed), int(often.sum())), np.float32)
    matrix[owner[common], place[column[common]]] = 1
    order = np.flatnonzero(~common)
    order = order[np.argsort(column[order], kind="stable")]
    holders = owner[order]
    start = np.searchsorted(column[order], np.arange(len(values) + 1))
    top = np.arange(len(names))

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return int(i)

    left, out = len(names), []
    for low in range(0, len(askers), _ASKERS):
        some = askers[low : low + _ASKERS]
        asked = np.concatenate([sets[i] for i in some])
        row = np.repeat(np.arange(len(some)), sizes[some])
        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        known = values[at] == asked
        at, row = at[known], row[known]
        frequent = often[at]
        part = np.zeros((len(some), matrix.shape[1]), np.float32)
        part[row[frequent], place[at[frequent]]] = 1
        rare, row = at[~frequent], row[~frequent]
        lengths = start[rare + 1] - start[rare]
        spots = np.repeat(start[rare] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        cells = np.repeat(row, lengths) * len(indexed) + holders[spots]
        shared = np.bincount(cells, minlength=len(some) * len(indexed)).reshape(len(some), len(indexed))
        shared += np.rint(part @ matrix.T).astype(np.int64)
        near = 100 * shared >= percent * (sizes[some][:, None] + sizes[indexed][None, :] - shared)
        now = np.array([root(i) for i in range(len(names))])
        i, j = np.nonzero(near & (now[of[some]][:, None] != now[of[indexed]][None, :]))
        # Each pair of components once.
        pairs = np.unique(np.stack([of[some[i]], of[indexed[j]]], axis=1), axis=0)
        for one, two in pairs.tolist():
            a, b = root(one), root(two)
            if a != b:
                top[max(a, b)] = min(a, b)
                left -= 1
                out.append((names[one], names[two]))
        if left == 1:
            break
    return out


def _links_between(cells: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): components that hold a pair of linked classes of one cell; each set goes to a cell once."""

    def linked(batches):
        cell, components, members, sides, out = None, [], [], [], []
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("region", "i", "j", "component", "members", "side"))
            for region, i, j, component, packed, side in zip(*columns, strict=True):
                if (region, i, j) != cell:
                    out += links_in_cell(components, members, sides, forest.percent) if len(components) > 1 else []
                    cell, components, members, sides = (region, i, j), [], [], []
                components.append(component)
                members.append(np.frombuffer(packed, np.uint64))
                sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["a", "b"])
            out = []
        out = links_in_cell(components, members, sides, forest.percent) if len(components) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    name = ["region", "i", "j"]
    met = cells.join(sets, "class").select("cell.region", "cell.i", "cell.j", "side", "component", "members")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, *name).sortWithinPartitions(*name).mapInArrow(linked, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap by ``percent`` of their union."""

    @F.arrow_udf("boolean")
    def overlap(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    met = pairs.join(sets.withColumnsRenamed({"class": "a", "members": "members_a"}), "a")
    met = met.join(sets.withColumnsRenamed({"class": "b", "members": "members_b"}), "b")
    return met.where(overlap("members_a", "members_b")).select("a", "b")


def _sets(documents: DataFrame, id_column: str, text_column: str, heads: DataFrame, forest: Forest) -> DataFrame:
    """(class, members): the full sets of some classes, from the text of one document of each."""

    def listed(batches):
        for batch in batches:
            found = [shingle_set(t.as_py(), forest.words) for t in batch["text"]]
            classes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
            members = pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([classes, members], ["class", "members"])

    texts = documents.select(F.col(id_column).cast("long").alias("head"), F.col(text_column).alias("text"))
    wanted = texts.join(heads.select("head").distinct(), texts["head"].eqNullSafe(heads["head"]), "left_semi").select("text")
    return wanted.mapInArrow(listed, "class binary, members binary")


def near_classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", forest: Forest = Forest()) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id of its component) and kept.

    Texts without words, and classes without links, are components of their own; a row is kept if its id is its
    component's, null equal to null.
    """
    bound_batches(documents.sparkSession)
    sketched = checkpointed(sketches(documents, id_column, text_column, forest))
    # Binary aggregates sort; equal sets have equal signatures, so any of a class will do.
    classes = sketched.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("id").alias("head"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")
    )
    classes = checkpointed(classes)
    rows = checkpointed(sketched.drop("signature"))
    forget(sketched)
    neighbours = _neighbours(classes, forest)
    close = checkpointed(neighbours.groupBy("a", "b").agg(F.max("fits").alias("fits")))
    entries = close.select("a").union(close.select("b")).distinct().toDF("class")
    # Only classes with a neighbour in some order can have candidates.
    crowd = checkpointed(classes.join(entries, "class", "left_semi"))
    sets = _sets(documents, id_column, text_column, crowd, forest)
    sets = checkpointed(sets.groupBy("class").agg(F.max("members").alias("members")))
    links = checkpointed(confirmed(close.where("fits").select("a", "b"), sets, forest.percent))
    forget(close)
    roots = components(links).withColumnRenamed("node", "class")
    component = F.coalesce("root", "class").alias("component")
    placed = checkpointed(crowd.join(roots, "class", "left").select(*crowd.columns, component))
    forget(crowd, links)
    for low in range(0, forest.orders, forest.round_orders):
        trees = list(range(low, min(low + forest.round_orders, forest.orders)))
        links = checkpointed(_links_between(_cells(placed, trees, forest), sets, forest).distinct())
        if not links.isEmpty():
            # What a round joins is one component in the next, whose regions may then be at rest.
            joined = components(links).withColumnsRenamed({"node": "component", "root": "top"})
            moved = lookup(placed, "component", joined).withColumn("component", F.coalesce("top", "component")).drop("top")
            before, placed = placed, checkpointed(moved)
            forget(before)
        forget(links)
    forget(sets)
    final = placed.select("class", "head", F.col("component").alias("top"))
    linked = lookup(final, "top", final.groupBy("top").agg(F.min("head").alias("component_id"))).select("class", "component_id")
    of_class = classes.select("class", "head").join(linked, "class", "left")
    of_class = checkpointed(of_class.select("class", F.coalesce("component_id", "head").alias("component_id")))
    forget(placed, classes)
    out = lookup(rows.where(F.col("class").isNotNull()), "class", of_class).select("id", "n_shingles", "component_id")
    empty = rows.where(F.col("class").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
