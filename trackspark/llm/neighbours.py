"""Nearest neighbours by largest inner product, with vantage-point trees.

The project keeps no vectors of its own, so this operator is general: rows of `vec_id` (a long) and `embedding` (an
array of numbers), as an appearance model of tracked objects would give.

Inner products become distances by one more component: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the largest product and the triangle inequality holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash60, pieces, written

#: Rows of the sample that the centres of regions are chosen from.
SAMPLE_ROWS = 4096
#: Regions at most; their centres and radii go to every task.
MOST_REGIONS = 256
#: Expected rows of a region; rows of a shard at most; queries that one task answers at once.
REGION_ROWS, SHARD_ROWS, QUERY_ROWS = 1024, 4096, 2048
LEAF = 48
#: A part of a tree is left out where FACTOR times its least possible distance is beyond the distance of the k-th found.
#: 1 is exact search. Above 1, recall depends on the vectors: where one is much longer than the rest, all distances are
#: about its length, and 1.6 leaves out nearly everything.
FACTOR = 1.0
#: Slack against rounding.
EPS = 1e-9


class VantageTree:
    """A vantage-point tree over the rows of `points` (with the added component)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        """A node is (rows) for a leaf, else (vantage row, border, (low, high) of both sides, inner node, outer node)."""
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (rows,)
            return at
        # The row farthest from the first one lies at the rim, where distances spread.
        far = rows[np.linalg.norm(self.points[rows] - self.points[rows[0]], axis=1).argmax()]
        d = np.linalg.norm(self.points[rows] - self.points[far], axis=1)
        order = d.argsort(kind="stable")
        half = len(rows) // 2
        near, away = order[:half], order[half:]
        spans = [(d[part].min(), d[part].max()) for part in (near, away)]
        self.nodes[at] = (far, d[order[half]], spans, self._build(rows[near]), self._build(rows[away]))
        return at


class Search:
    """The k best of a shard for a block of queries."""

    def __init__(self, tree: VantageTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, norm2: float, k: int, factor: float):
        self.tree, self.ids, self.queries, self.query_ids, self.k, self.factor = tree, ids, queries, query_ids, k, factor
        self.vectors = tree.points[:, :-1]
        self.square = (queries**2).sum(axis=1) + norm2
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        #: The distance beyond which nothing is of use: what is known from elsewhere, then the k-th found here.
        self.reach = reach.copy()
        self._visit(tree.root, np.arange(len(queries)))

    def _distance(self, who: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[who] - 2 * (self.queries[who] @ self.vectors[row]), 0))

    def _visit(self, at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        node = self.tree.nodes[at]
        if len(node) == 1:
            self._leaf(node[0], who)
            return
        vantage, border, spans, *sides = node
        d = self._distance(who, vantage)
        inside = d <= border
        least = [np.maximum(np.maximum(d - high, low - d), 0) for low, high in spans]
        for first, second, mine in ((0, 1, inside), (1, 0, ~inside)):
            for side in (first, second):
                left = mine & (self.factor * least[side] <= self.reach[who] + EPS)
                self._visit(sides[side], who[left])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        rough = self.queries[who] @ self.vectors[rows].T
        # Neither below the k-th found here nor beyond the reach known from elsewhere.
        least = np.maximum(self.scores[who, -1], (self.square[who] - self.reach[who] ** 2) / 2)
        worth = (rough >= least[:, None] - EPS) & (self.query_ids[who][:, None] != self.ids[rows][None])
        some = worth.any(axis=1)
        who, worth = who[some], worth[some]
        if not len(who):
            return
        q, r = np.nonzero(worth)
        exact = np.full(worth.shape, -np.inf)
        # Products are summed pair by pair, so that equal vectors have equal scores.
        exact[q, r] = (self.queries[who[q]] * self.vectors[rows[r]]).sum(axis=1)
        scores = np.concatenate([self.scores[who], exact], axis=1)
        found = np.concatenate([self.found[who], np.where(worth, self.ids[rows][None], np.iinfo(np.int64).max)], axis=1)
        best = np.lexsort((found, -scores), axis=-1)[:, : self.k]
        self.scores[who], self.found[who] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)
        kth = self.scores[who, -1]
        full = kth > -np.inf
        self.reach[who[full]] = np.minimum(self.reach[who[full]], np.sqrt(np.maximum(self.square[who[full]] - 2 * kth[full], 0)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), norm2 of the rows that take part.

    Left out are null ids, null or empty vectors, those with a null or non-finite component, vectors of zeros only (not those
    whose squares are too small for a double), and vectors of another length than most (ties: the longer).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("norm2", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).filter(F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("embedding") == (common["d"] if common else 0))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _centres(points: np.ndarray, regions: int) -> np.ndarray:
    """Centres by a few rounds of k-means over the sample, started from evenly spaced rows."""
    centres = points[np.linspace(0, len(points) - 1, min(regions, len(points))).astype(int)]
    for _ in range(8):
        own = _nearest(points, centres)[0]
        centres = np.stack([points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return np.unique(centres, axis=0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the distances to all."""
    d = np.sqrt(np.maximum((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * points @ centres.T, 0))
    return d.argmin(axis=1), d


class VantageIndex:
    """All usable vectors in regions around centres, and shards of bounded size inside these.

    The centres come from a bounded sample; every row is in the index. `rows` (vec_id, embedding, region, shard) is a table in the
    shared folder; `stats` has a region's least and largest distance and its number of shards.
    """

    def __init__(self, vectors: DataFrame, regions: int | None = None, shard_rows: int = SHARD_ROWS):
        rows = usable(vectors)
        total, top = rows.agg(F.count(F.lit(1)), F.max("norm2")).first()
        self.norm2 = norm2 = (top or 0.0) * (1 + EPS)
        self.rows, self.stats = None, {}
        if not total:
            return
        sample = rows.orderBy(hash60(F.col("vec_id")), "vec_id").limit(SAMPLE_ROWS).select("embedding", "norm2").toPandas()
        widened = lambda pdf: np.column_stack([_matrix(pdf["embedding"]), np.sqrt(np.maximum(norm2 - pdf["norm2"].to_numpy(), 0))])
        self.centres = centres = _centres(widened(sample), regions or min(MOST_REGIONS, pieces(total, REGION_ROWS)))

        def assign(batches):
            for batch in batches:
                own, d = _nearest(widened(batch), centres)
                yield batch.assign(region=own.astype(np.int32), distance=d[np.arange(len(own)), own])

        placed = written(rows.mapInPandas(assign, "vec_id long, embedding array<double>, norm2 double, region int, distance double"), "vectors")
        found = placed.groupBy("region").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        self.stats = {r["region"]: (r["low"], r["high"], pieces(r["n"], shard_rows)) for r in found}
        shards = F.element_at(F.create_map(*[F.lit(x) for i, s in self.stats.items() for x in (i, s[2])]), F.col("region"))
        self.rows = placed.select("vec_id", "embedding", "norm2", "region", F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard"))

    def _routed(self, queries: DataFrame, first: bool, factor: float) -> DataFrame:
        """One row per query and region to visit: query_id, embedding, reach, region; first: its nearest region only."""
        centres, stats, norm2 = self.centres, self.stats, self.norm2
        have = np.array(sorted(stats))
        low, high = np.array([stats[i][0] for i in have]), np.array([stats[i][1] for i in have])

        def route(batches):
            for batch in batches:
                if not len(batch):
                    continue
                q = _matrix(batch["embedding"])
                # A query's added component is 0.
                d = _nearest(np.column_stack([q, np.zeros(len(q))]), centres)[1][:, have]
                home = d.argmin(axis=1)
                if first:
                    yield batch.assign(region=have[home].astype(np.int32))
                    continue
                # A point of another region is nearer to its own centre than to the query's nearest one.
                least = np.maximum(np.maximum(d - high, low - d), (d - d.min(axis=1)[:, None]) / 2)
                visit = factor * least <= batch["reach"].to_numpy()[:, None] + EPS
                visit[np.arange(len(q)), home] = False
                who, where = np.nonzero(visit)
                yield batch.iloc[who].assign(region=have[where].astype(np.int32))

        return queries.mapInPandas(route, "query_id long, embedding array<double>, reach double, region int")

    def _searched(self, routed: DataFrame, k: int, factor: float) -> DataFrame:
        """query_id, vec_id, score of the k best of every shard that a query visits, of those within its reach.

        Shards and, where many queries visit a region, blocks of queries make groups of bounded size.
        """
        norm2, shards = self.norm2, {i: s[2] for i, s in self.stats.items()}
        asked = {r["region"]: pieces(r["n"], QUERY_ROWS) for r in routed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            return routed.select("query_id", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score")).limit(0)
        lookup = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("region"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = self.rows.withColumn("blocks", lookup(asked)).filter("blocks IS NOT NULL").withColumn("block", upto(F.col("blocks")))
        right = routed.withColumn("shard", upto(lookup(shards))).withColumn("block", F.pmod(F.xxhash64("query_id"), lookup(asked)).cast("int"))

        def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(queries):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
            tree = VantageTree(np.column_stack([_matrix(points["embedding"]), np.sqrt(np.maximum(norm2 - points["norm2"].to_numpy(), 0))]))
            names = queries["query_id"].to_numpy()
            out = Search(tree, points["vec_id"].to_numpy(), _matrix(queries["embedding"]), names, queries["reach"].to_numpy(), norm2, k, factor)
            q, r = np.nonzero(out.scores > -np.inf)
            return pd.DataFrame({"query_id": names[q], "vec_id": out.found[q, r], "score": out.scores[q, r]})

        keys = ["region", "shard", "block"]
        return left.select("vec_id", "embedding", "norm2", *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def nearest(self, queries: DataFrame, k: int = 20, factor: float = FACTOR) -> DataFrame:
        """The k best of all rows but the query's own: query_id, rank (from 1), vec_id, score.

        queries: query_id, embedding, norm2. First every query searches its nearest region, which gives the distance of its k-th
        best; then the regions that may hold a nearer one. With fewer than k rows in its region a query visits all.
        """
        if self.rows is None:
            return queries.selectExpr("query_id", "CAST(1 AS INT) AS rank", "query_id AS vec_id", "CAST(0 AS DOUBLE) AS score").limit(0)
        here = written(self._searched(self._routed(queries.select("query_id", "embedding", F.lit(float("inf")).alias("reach")), True, factor), k, factor), "near")
        square = F.col("norm2") + F.lit(self.norm2)
        known = _ranked(here, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(square - 2 * F.col("kth"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
        onward = queries.join(known, "query_id", "left").select("query_id", "embedding", F.coalesce(reach, F.lit(float("inf"))).alias("reach"))
        routed = written(self._routed(onward, False, factor), "routed")
        return _ranked(here.unionByName(self._searched(routed, k, factor)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """The k rows of `vectors` with the largest inner product for every query.

    Both inputs: vec_id (a long), embedding (array of numbers); other columns are ignored. Result: query_id, rank (from 1), vec_id,
    score (the inner product of the original vectors in double precision); ties go to the smaller vec_id. A query is not
    its own neighbour; with fewer than k others it gets all of them. Rows that `usable` leaves out take no part, on either
    side. Of queries with one id the least vector counts, component by component. Empty tables give no rows. factor 1, the default, is exact; above it, parts of
    trees are left out sooner, with no bound on what is lost.
    """
    index = VantageIndex(vectors)
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("embedding", "norm2")).alias("v")).select("query_id", "v.*")
    return index.nearest(asked, k, factor)
