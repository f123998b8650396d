"""Nearest neighbours by inner product, with vantage-point trees.

Inner products become distances by one more dimension: a vector x gets sqrt(M^2 - |x|^2), M being the largest norm, and a
query gets 0; then the nearest point has the largest product. A tree node splits its points by their distance to a
vantage point; by the triangle inequality a side can be left out if the query's distance to the split exceeds its k-th best
distance so far. `relax` divides that distance: above 1 fewer nodes are visited, at 1 the search is exact.

Shards follow the same bound: some vectors of a sample are pivots, every vector goes to the cell of its nearest pivot, and large
cells fall into several shards. A query is first searched for in its own cell. What it finds there, and the triangle inequality
with the pivots, rule out other cells; it goes to those that are left. A shard's rows come before the queries in its partition, so a
task holds one tree and lets queries pass through in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mapped, partitions_for

#: Vectors in a shard at most, points in a leaf, and neighbours kept beyond k until products are computed anew.
SHARD_ROWS, LEAF, SPARE = 65_536, 256, 12
#: Vectors for a cell at least and cells at most, which bounds the sample of pivots; queries that a shard's tree is planted for.
CELL_ROWS, CELLS, QUERY_ROWS = 2048, 4096, 65_536


class VpTree:
    """A vantage-point tree over the rows of `points`; rows are reordered so that each node is a range."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(len(points))
        waiting = [(0, len(points), -1, 0)]
        while waiting:
            begin, end, parent, side = waiting.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if end - begin <= LEAF:
                self.nodes.append([begin, end, None, None, -1, -1])
                continue
            own = self.order[begin:end]
            vantage = points[own[rng.integers(end - begin)]]
            away = np.sqrt(np.maximum(((points[own] - vantage) ** 2).sum(1), 0))
            middle = (end - begin) // 2
            by = np.argpartition(away, middle)
            self.order[begin:end] = own[by]
            away = away[by]
            inner, outer = away[:middle], away[middle:]
            self.nodes.append([begin, end, vantage, (inner.min(), inner.max(), outer.min(), outer.max()), -1, -1])
            waiting += [(begin, begin + middle, me, 0), (begin + middle, end, me, 1)]
        self.points = points[self.order]

    def search(self, queries: np.ndarray, k: int, relax: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows (in the given order; -1: none) and squared distances of each query's k nearest points; of those nearer than `bound`,
        if given."""
        m = len(queries)
        near, rows = np.full((m, k), np.inf), np.full((m, k), -1, np.int64)
        if bound is not None:
            near[:] = (bound**2 * (1 + 1e-9) + 1e-9)[:, None]
        home = np.full(m, -1)
        square = (queries**2).sum(1)

        def look(leaf: int, who: np.ndarray) -> None:
            begin, end = self.nodes[leaf][:2]
            part = self.points[begin:end]
            away = np.maximum(square[who, None] + (part**2).sum(1) - 2 * queries[who] @ part.T, 0)
            all_away = np.concatenate([near[who], away], axis=1)
            all_rows = np.concatenate([rows[who], np.broadcast_to(self.order[begin:end], away.shape)], axis=1)
            best = np.argpartition(all_away, k - 1, axis=1)[:, :k]
            near[who], rows[who] = np.take_along_axis(all_away, best, 1), np.take_along_axis(all_rows, best, 1)

        def gap(away: np.ndarray, low: float, high: float) -> np.ndarray:
            """Least distance that points between low and high from the vantage point can have."""
            return np.maximum(np.maximum(low - away, away - high), 0)

        # first each query's own leaf, for a bound; then the whole tree, as far as the bounds allow
        waiting = [(0, np.arange(m))]
        while waiting:
            node, who = waiting.pop()
            _, _, vantage, span, left, right = self.nodes[node]
            if vantage is None:
                home[who] = node
                look(node, who)
                continue
            away = np.sqrt(((queries[who] - vantage) ** 2).sum(1))
            inside = gap(away, *span[:2]) < gap(away, *span[2:])
            tie = gap(away, *span[:2]) == gap(away, *span[2:])
            inside |= tie & (away <= span[1])
            waiting += [(n, w) for n, w in ((left, who[inside]), (right, who[~inside])) if w.size]
        waiting = [(0, np.arange(m), np.zeros(m))]
        while waiting:
            node, who, least = waiting.pop()
            keep = least <= np.sqrt(near[who].max(1)) / relax
            who, least = who[keep], least[keep]
            if not who.size:
                continue
            _, _, vantage, span, left, right = self.nodes[node]
            if vantage is None:
                if (who := who[home[who] != node]).size:
                    look(node, who)
                continue
            away = np.sqrt(((queries[who] - vantage) ** 2).sum(1))
            waiting += [(left, who, np.maximum(least, gap(away, *span[:2]))), (right, who, np.maximum(least, gap(away, *span[2:])))]
        return rows, near


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Cells:
    """The pivots of a sample, and bounds on the distances of queries from what is in their cells."""

    def __init__(self, pivots: np.ndarray, square: float) -> None:
        self.square = square
        self.pivots = self.lifted(pivots)
        self.radius = np.zeros(len(pivots))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.sqrt(np.maximum(self.square - (vectors**2).sum(1), 0))])

    def away(self, lifted: np.ndarray) -> np.ndarray:
        """(row, pivot) distances."""
        return np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T, 0))

    def open(self, queries: np.ndarray, home: np.ndarray, score: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell) pairs whose cells may hold more than the home cell's k-th score, and each query's distance at that score."""
        away = self.away(np.column_stack([queries, np.zeros(len(queries))]))
        reach = np.sqrt(np.maximum((queries**2).sum(1) + self.square - 2 * score, 0))
        least = np.maximum(away - self.radius, (away - away[np.arange(len(home)), home][:, None]) / 2)
        may = (least <= reach[:, None] / relax) & (self.radius >= 0)
        may[np.arange(len(home)), home] = False
        return *np.nonzero(may), reach


def _trees(width: int, square: float, k: int, relax: float):
    """A function over batches (shard, kind, id, v, bound), sorted: what each shard's tree finds for its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, held, tree = None, [], [], None

        def plant() -> tuple:
            """The tree over the shard's distinct vectors, and for each of them the ids (at most k + 1, the smallest) that have it."""
            every, owner = np.concatenate(held), np.concatenate(ids)
            _, first, same = np.unique(every, axis=0, return_index=True, return_inverse=True)
            distinct = every[first]
            order = np.lexsort((owner, same.ravel()))
            bounds = np.searchsorted(same.ravel()[order], np.arange(len(first) + 1))
            extra = np.sqrt(np.maximum(square - (distinct**2).sum(1), 0))
            return VpTree(np.column_stack([distinct, extra])), distinct, (owner[order], bounds)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                change = np.flatnonzero((shards[at:] != shards[at]) | (kinds[at:] != kinds[at]))
                end = at + int(change[0]) if change.size else batch.num_rows
                part = batch.slice(at, end - at)
                if shards[at] != shard:
                    shard, ids, held, tree = shards[at], [], [], None
                own, matrix = part.column(2).to_numpy(), _matrix(part.column(3), width)
                if kinds[at] == 0:
                    ids.append(own)
                    held.append(matrix)
                elif held or tree:
                    if tree is None:
                        tree, held = plant(), []
                    yield from answer(tree, own, matrix, part.column(4).to_numpy())
                at = end

    def answer(tree: tuple, own: np.ndarray, asked_for: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        grown, distinct, (owner, bounds) = tree
        most = min(k + 1 + SPARE, len(distinct))
        for at in range(0, len(own), 1024):
            some, vectors = own[at : at + 1024], asked_for[at : at + 1024]
            rows, _ = grown.search(np.column_stack([vectors, np.zeros(len(some))]), most, relax, bound[at : at + 1024])
            who, column = np.nonzero(rows >= 0)
            row = rows[who, column]
            score = np.einsum("ij,ij->i", vectors[who], distinct[row])
            many = np.minimum(bounds[row + 1] - bounds[row], k + 1)
            place = np.repeat(bounds[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, score, found = np.repeat(who, many), np.repeat(score, many), owner[place]
            other = found != some[who]
            who, score, found = who[other], score[other], found[other]
            order = np.lexsort((found, -score, who))
            who, score, found = who[order], score[order], found[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            top = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(some[who[top]]), pa.array(found[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    relax: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner products with each query.

    Ranks count from 1, ties go to the smaller id; a query never meets its own id; with fewer rows all are returned. Vectors
    that are null, zero, or hold null or non-finite components, that have another length than most, and rows with a null id take
    no part. A repeated id counts once, with its best score. Without usable vectors or queries the result is empty. Other
    columns are left out, so their names can't clash.

    Pivots are a sample of at most CELLS vectors, by the order of a hash of their ids; every row is indexed.
    """

    def usable(df: DataFrame) -> DataFrame:
        given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return given.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))

    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "nearest")
    points = usable(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = points.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("square")).orderBy(F.desc("n"), "width").limit(1).collect()
    width, n, square = (sizes[0]["width"], sizes[0]["n"], sizes[0]["square"]) if sizes else (1, 0, 0.0)
    right = F.size("v") == width
    sample = points.where(right).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(max(1, min(CELLS, n // cell_rows))).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = Cells(np.unique(np.array([r["v"] for r in sample], float).reshape(-1, width), axis=0), square)

    def placed(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _matrix(batch.column(1), width)
                away = cells.away(np.column_stack([own, np.zeros(len(own))]) if asked else cells.lifted(own))
                cell = away.argmin(1)
                arrays = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "away", "id", "v"])

        return run

    schema = "cell int, away double, id long, v array<double>"
    held = scratch.write(mapped(points.where(right), placed(False), schema), "points")
    asked = scratch.write(mapped(usable(queries).where(right), placed(True), schema), "queries")
    stats = {r["cell"]: (r["n"], r["radius"]) for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # CELLS rows at most
    cells.radius = np.array([stats[c][1] * (1 + 1e-9) if c in stats else -1.0 for c in range(len(cells.pivots))])

    def searched(rows: DataFrame) -> DataFrame:
        """What queries (cell, id, v, bound) find in their cells."""
        wanted = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect() if r["cell"] in stats}  # CELLS rows at most
        spec, base = [], 0
        for cell in sorted(wanted):
            shards, parts = -(-stats[cell][0] // shard_rows), -(-wanted[cell] // query_rows)
            spec.append((cell, base, shards, parts))
            base += shards * parts
        plan = F.broadcast(spark.createDataFrame(spec, "cell int, base long, shards long, parts long"))
        one = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        index = held.join(plan, "cell").select("*", one("shards").alias("shard"), every("parts").alias("part")).withColumns({"kind": F.lit(0), "bound": F.lit(float("inf"))})
        asks = rows.join(plan, "cell").select("*", one("parts").alias("part"), every("shards").alias("shard")).withColumn("kind", F.lit(1))
        columns = [(F.col("base") + F.col("part") * F.col("shards") + F.col("shard")).alias("shard"), "kind", "id", "v", "bound"]
        dealt = index.select(columns).unionByName(asks.select(columns)).repartition(max(1, min(base, 8 * partitions_for(spark))), "shard")
        return mapped(dealt.sortWithinPartitions("shard", "kind", "id"), _trees(width, square, k, relax), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = part.column(3).fill_null(-np.inf).to_numpy()
                query, cell, reach = cells.open(_matrix(part.column(2), width), part.column(0).to_numpy(), score, relax)
                rows = pa.array(query)
                arrays = [pa.array(cell.astype(np.int32)), part.column(1).take(rows), part.column(2).take(rows), pa.array(reach[query])]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "id", "v", "bound"])

    near = scratch.write(ranked(searched(asked.select("cell", "id", "v", F.lit(float("inf")).alias("bound")))), "near")
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    left = scratch.write(mapped(asked.join(least, "id", "left").select("cell", "id", "v", "score"), opened, "cell int, id long, v array<double>, bound double"), "left")
    far = searched(left)
    return ranked(near.select("query_id", "vec_id", "score").unionByName(far)).select("query_id", "rank", "vec_id", "score")
