"""Nearest neighbours by inner product from a hierarchical k-means tree.

1. Equal vectors are one entry with its smallest identifiers (as many as can be answers).
2. **Tree**: k-means splits a sample of at most ``SAMPLE_VALUES`` numbers into ``BRANCHES`` parts, each
   part again, down to the size of a leaf. The sample is chosen by a hash of the vectors. Every entry
   is then indexed: it goes to the leaf that the nearest centres lead to.
3. **Traversal**: best bin first. A priority queue holds the nodes met so far by the inner product of
   query and centre; the best is opened, until as many leaves as asked for, and at least k
   candidates, have been visited.
4. **Calibration**: up to ``CALIBRATION`` queries are answered exactly by a pass over all entries. The
   leaves to visit are widened until ``recall`` of their neighbours lie in visited leaves. A tree starts with about
   ``LEAVES`` leaves; it gets ``BRANCHES`` times as many as long as that halves the share of all entries that
   has to be visited. So clustered vectors get deep trees, and where none helps, visits stay few.
5. **Search**: queries meet the entries of their leaves in blocks of both, so a task has bounded work
   whatever the size of a leaf or the number of its queries; blocks keep their best entries, the
   best of a query are ranked. Scores are sums of products in the order of components, in double precision.

Null, zero and non-finite vectors and those with a null component take no part, nor do rows without
an identifier. Shorter vectors count as filled up with zeros. Of different vectors of one identifier
the smallest counts, repeated rows count once. Ties go to the smaller identifier. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import join_groups, stage

SAMPLE_VALUES = 4_000_000
BRANCHES = 8
LEAVES = 64
LEAF_SAMPLE = 16
ROUNDS = 12
CALIBRATION = 256
BLOCK = 2048
RECALL = 0.96


class Tree:
    """Centres of all nodes; a node's children lie next to each other."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.centres, self.children, self.leaf_of = [sample.mean(axis=0)], [(0, 0)], [-1]
        draw, todo, leaves = np.random.default_rng(7), [(0, sample)], 0
        while todo:
            node, rows = todo.pop()
            parts = _split(rows, min(BRANCHES, -(-len(rows) // leaf_rows)), draw) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                self.leaf_of[node] = leaves
                leaves += 1
                continue
            first = len(self.centres)
            self.children[node] = (first, first + len(parts))
            for part in parts:
                todo.append((len(self.centres), part))
                self.centres.append(part.mean(axis=0))
                self.children.append((0, 0))
                self.leaf_of.append(-1)
        self.centres = np.array(self.centres)
        self.leaves = leaves

    def leaves_for(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre, level by level."""
        at, found = [(0, np.arange(len(rows)))], np.zeros(len(rows), dtype=np.int32)
        while at:
            node, members = at.pop()
            first, last = self.children[node]
            if first == last:
                found[members] = self.leaf_of[node]
                continue
            nearest = _nearest(rows[members], self.centres[first:last])
            at += [(first + child, members[nearest == child]) for child in np.unique(nearest).tolist()]
        return found

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best bin first."""
        near = (self.centres @ query).tolist()
        queue = [(-near[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            first, last = self.children[node]
            if first == last:
                yield self.leaf_of[node]
            for child in range(first, last):
                heapq.heappush(queue, (-near[child], child))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) / 2 - rows @ centres.T, axis=1)


def _split(rows: np.ndarray, parts: int, draw: np.random.Generator) -> list[np.ndarray]:
    """k-means of rows that are all different; parts that ran empty are left out."""
    centres = rows[draw.choice(len(rows), parts, replace=False)]
    for _ in range(ROUNDS):
        nearest = _nearest(rows, centres)
        sizes = np.bincount(nearest, minlength=parts)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    nearest = _nearest(rows, centres)
    return [rows[nearest == part] for part in np.unique(nearest)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if np.all(sizes == width):
        return values.reshape(-1, width)
    rows = np.zeros((len(column), width))
    rows[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return rows


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up component by component."""
    total = np.zeros(len(rows))
    for place in range(rows.shape[1]):
        total += queries[:, place] * rows[:, place]
    return total


def best_pairs(queries: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``most`` best rows, with all that tie with the last of them."""
    scores = queries @ rows.T
    if rows.shape[0] > most:
        limit = np.partition(scores, -most, axis=1)[:, -most][:, None]
        kept = scores >= limit - 1e-9 * (1 + np.abs(limit))
    else:
        kept = np.ones(scores.shape, dtype=bool)
    query, row = np.nonzero(kept)
    return query, row, products(queries[query], rows[row])


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def usable_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v of the rows that take part, one per identifier."""
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return plain.where(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """Different vectors: v and its ``most`` smallest identifiers; of equal ones no more than these meet."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def sampled(entries: DataFrame, n_entries: int, width: int) -> np.ndarray:
    """Vectors to fit trees on, bounded in numbers, whatever there is to index."""
    share = min(1.0, SAMPLE_VALUES / width / n_entries)
    chosen = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = (entries.where(chosen) if share < 1 else entries).select("v").orderBy("v").toArrow()["v"]
    return matrix(sample.combine_chunks(), width)


def indexed(tree: Tree, width: int):
    """mapInArrow function: (key, v, ids) with the leaf."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.leaves_for(matrix(batch["v"], width))
            yield batch.append_column("leaf", pa.array(leaves, pa.int32()))

    return index


def visited(tree: Tree, width: int, leaves: int, n_ids: list[int], least: int):
    """mapInArrow function: (key, v) with the leaves to search: ``leaves``, more until there are ``least`` candidates."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for query in matrix(batch["v"], width):
                chosen, met = [], 0
                for leaf in tree.visits(query):
                    if len(chosen) >= leaves and met >= least:
                        break
                    chosen.append(leaf)
                    met += n_ids[leaf]
                lists.append(chosen)
            yield batch.append_column("leaves", pa.array(lists, pa.list_(pa.int32())))

    return visit


HITS = "query bigint, score double, id bigint"


def _hits(keys, query, scores, ids: pa.Array, row) -> pa.RecordBatch:
    """Rows of HITS, one for each identifier of the entries found."""
    lists = ids.take(pa.array(row))
    times = np.diff(lists.offsets.to_numpy())
    spread = lambda values: pa.array(np.repeat(values, times))
    return pa.RecordBatch.from_arrays(
        [spread(keys[query]), spread(scores), lists.flatten()], names=["query", "score", "id"]
    )


def all_hits(keys: np.ndarray, queries: np.ndarray, width: int, most: int):
    """mapInArrow function: the best of a batch of entries (key, v, ids) for each of a few queries, with their keys."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(low, BLOCK)
                query, row, scores = best_pairs(queries, matrix(batch["v"], width), most)
                hits = _hits(keys, query, scores, batch["ids"], row)
                times = np.diff(batch["ids"].take(pa.array(row)).offsets.to_numpy())
                yield hits.append_column("key", pa.array(np.repeat(batch["key"].to_numpy()[row], times)))

    return search


def unit_hits(width: int, most: int):
    """Cogroup function: the best entries of a block of a leaf for each query of a block that visits it."""

    def search(queries: pa.Table, entries: pa.Table) -> pa.Table:
        asked, held = queries.combine_chunks().to_batches(), entries.combine_chunks().to_batches()
        if not asked or not held:
            return pa.table({name: pa.array([], kind) for name, kind in zip(
                ("query", "score", "id"), (pa.int64(), pa.float64(), pa.int64()))})
        query, row, scores = best_pairs(matrix(asked[0]["v"], width), matrix(held[0]["v"], width), most)
        return pa.Table.from_batches([_hits(asked[0]["key"].to_numpy(), query, scores, held[0]["ids"], row)])

    return search


def _first(hits: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def known_answers(queries: DataFrame, entries: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) as rows of vectors: all neighbours of a few queries, from a pass over all entries."""
    share = min(1.0, CALIBRATION / queries.count())
    chosen = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
    told = (queries.where(chosen) if share < 1 else queries).select("key", "v").orderBy("key").toArrow().combine_chunks()
    if not told.num_rows:
        return np.empty((0, width)), np.empty((0, width))
    keys, rows = told["key"].to_numpy(), matrix(told["v"].combine_chunks(), width)
    hits = entries.select("key", "v", "ids").mapInArrow(all_hits(keys, rows, width, k + 1), HITS + ", key bigint")
    best = _first(hits, k + 1).select("query", "key").join(entries.select("key", "v"), "key")
    found = best.select("query", "v").toArrow().combine_chunks()
    asked = rows[np.searchsorted(keys, found["query"].to_numpy())]
    return asked, matrix(found["v"].combine_chunks(), width)


def calibrated(tree: Tree, sample: np.ndarray, asked: np.ndarray, found: np.ndarray, recall: float) -> tuple[int, float]:
    """Leaves to visit so that ``recall`` of the known answers is met, and the share of all entries they hold."""
    if not len(asked):
        return tree.leaves, 1.0
    queries, of = np.unique(asked, axis=0, return_inverse=True)
    orders = [np.fromiter(tree.visits(query), dtype=np.int64, count=tree.leaves) for query in queries]
    ranks = np.empty((len(queries), tree.leaves), dtype=np.int64)
    for number, order in enumerate(orders):
        ranks[number, order] = np.arange(1, tree.leaves + 1)
    met = np.sort(ranks[of.reshape(-1), tree.leaves_for(found)])
    visits = int(met[max(0, int(np.ceil(recall * len(met))) - 1)])
    sizes = np.bincount(tree.leaves_for(sample), minlength=tree.leaves)
    return visits, float(np.mean([sizes[order[:visits]].sum() for order in orders]) / len(sample))


def fit(sample: np.ndarray, asked: np.ndarray, found: np.ndarray, recall: float, leaves: int) -> tuple[Tree, int]:
    """The tree to search and how many of its leaves to visit."""
    best, least = None, None
    while True:
        leaf_rows = max(LEAF_SAMPLE, -(-len(sample) // leaves))
        tree = Tree(sample, leaf_rows)
        visits, share = calibrated(tree, sample, asked, found, recall)
        if best is not None and share > least / 2:
            return best
        best, least = (tree, visits), share
        if leaf_rows == LEAF_SAMPLE:
            return best
        leaves *= BRANCHES


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    recall: float = RECALL, leaves: int = LEAVES, folder: str | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row whose identifier ``every`` divides."""
    spark, most = vectors.sparkSession, k + 1
    rows = stage(usable_rows(vectors, vec_id, embedding), "vectors", folder)
    asking = rows.where(F.col("id") % every == 0)
    entries = stage(
        entries_of(rows, most).withColumn("key", F.monotonically_increasing_id()), "vector-entries", folder
    )
    n_entries, width = entries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n_entries:
        return spark.createDataFrame([], schema)
    groups = asking.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    queries = stage(groups.join(entries.select("key", "v"), "v"), "vector-queries", folder)
    if queries.isEmpty():
        return spark.createDataFrame([], schema)
    asked, found = known_answers(queries, entries, width, k)
    tree, visits = fit(sampled(entries, n_entries, width), asked, found, recall, leaves)
    entries = stage(
        entries.select("key", "v", "ids").mapInArrow(
            indexed(tree, width), "key bigint, v array<double>, ids array<bigint>, leaf int"
        ),
        "vector-index", folder,
    )
    sizes = entries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("n_ids")).toArrow()
    n_rows, n_ids = np.zeros(tree.leaves, dtype=np.int64), [0] * tree.leaves
    for leaf, n, ids in zip(*(sizes[name].to_pylist() for name in ("leaf", "n", "n_ids"))):
        n_rows[leaf], n_ids[leaf] = n, ids
    asked = stage(
        queries.select("key", "v").mapInArrow(
            visited(tree, width, visits, n_ids, most), "key bigint, v array<double>, leaves array<int>"
        ).select("key", "v", F.explode("leaves").alias("leaf")),
        "vector-visits", folder,
    )
    asks = dict(map(tuple, asked.groupBy("leaf").agg(F.count(F.lit(1))).collect()))
    plan = F.broadcast(spark.createDataFrame(
        [(leaf, int(-(-n_rows[leaf] // BLOCK)), -(-n // BLOCK)) for leaf, n in asks.items()],
        "leaf int, row_blocks int, query_blocks int",
    ))
    own = lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = asked.join(plan, "leaf").select("key", "v", "leaf", own("query_blocks").alias("q"), each("row_blocks").alias("b"))
    right = entries.join(plan, "leaf").select(
        "v", "ids", "leaf", own("row_blocks").alias("b"), each("query_blocks").alias("q"),
    )
    units = ["leaf", "b", "q"]
    hits = left.groupBy(*units).cogroup(right.groupBy(*units)).applyInArrow(unit_hits(width, most), HITS)
    found = _first(hits, most).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found")
    )
    answers = stage(queries.join(found, F.col("key") == F.col("query")).select("v", "n", "found"), "vector-answers", folder)
    told = join_groups(asking, answers, ["v"], "n").select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda hit: hit["id"] != F.col("id")), 1, k)).alias("at", "hit"),
    )
    return told.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
