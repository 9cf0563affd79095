"""Exact inner-product top-k by ball trees with branch and bound.

Candidates are dealt to shards of a bounded size by a coarse tree, fitted on a
bounded sample, so that a shard's rows lie together; each shard's ball holds
all of its rows. A task builds one ball tree per shard and runs the shard's
queries down it in blocks, leaving out what can't reach a query's kth score by
the upper bound q.centre + |q| * radius. Leaves are visited in the order of
each query's bounds until its kth score is high, then leaf by leaf for all the
queries that it may still serve. A first pass over each query's home shard
gives a kth score, and a query goes on only to the shards whose ball can beat
it, starting from that score there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.storage import discard, materialise

LEAF = 256
#: Leaves that each query visits in its own order first.
OWN_ORDER = 3
#: No score; the least real one is above it.
NONE = -(2**63)
BEST = 2**63 - 1
#: Vectors on which the dealing of rows to shards is fitted.
SAMPLE = 10_000


def reach(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """Upper bounds of the queries' scores in a ball, with room for the rounding of float64."""
    return queries @ centre + norms * (radius + 1e-9 * (radius + np.sqrt((centre**2).sum()))) + 1e-6


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued float64 vectors; those beyond a long count as its bound."""
    if not len(queries) or not len(rows):
        return np.empty((len(queries), len(rows)), np.int64)
    high = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if high < 2**53:  # so is every partial sum
        return (queries @ rows.T).astype(np.int64)
    if high < 2**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object)
    return np.clip(whole(queries) @ whole(rows).T, NONE + 1, BEST).astype(np.int64)


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line between two far points, and the rows' places along it."""
    away = ((rows - rows.mean(axis=0)) ** 2).sum(axis=1)
    p = rows[away.argmax()]
    q = rows[((rows - p) ** 2).sum(axis=1).argmax()]
    line = (q - p) / max(1.0, float(np.abs(q - p).max()))
    return line, rows @ line


class BallTree:
    """Rows split in halves along the line between two far points; each node has a centre and a radius."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, left, right
        self._build(0, len(self.ids))

    def _build(self, a: int, b: int) -> int:
        part = self.rows[a:b]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max())
        me = len(self.nodes)
        self.nodes.append((centre, radius, a, b, -1, -1))
        if b - a > LEAF and radius > 0:
            order = np.argsort(halves(part)[1], kind="stable")
            self.rows[a:b], self.ids[a:b] = part[order], self.ids[a:b][order]
            mid = (a + b) // 2
            left = self._build(a, mid)
            right = self._build(mid, b)
            self.nodes[me] = (*self.nodes[me][:4], left, right)
        return me

    def _leaves(self, queries: np.ndarray, floor: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Leaves that may hold rows of at least ``floor``, with the queries they may serve and their bounds."""
        norms = np.sqrt((queries**2).sum(axis=1))
        out, stack = [], [(0, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            centre, radius, _, _, left, right = self.nodes[node]
            up = reach(queries[at], norms[at], centre, radius)
            able = up >= floor[at]
            if able.any():
                if left < 0:
                    out.append((node, at[able], up[able]))
                else:
                    stack += [(left, at[able]), (right, at[able])]
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, [queries, k], of the best rows of at least ``floor``; NONE where there are fewer. ``own``: the id a query doesn't match."""
        n = len(queries)
        score, ident = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        left = self._leaves(queries, floor)
        if not left:
            return score, ident
        leaf, at, up = (np.concatenate(x) for x in zip(*((np.full(len(a), i), a, u) for i, (_, a, u) in enumerate(left))))
        order = np.lexsort((leaf, -up, at))
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        highest = np.argsort([-float(u.max()) for _, _, u in left], kind="stable")

        def visit(chosen: np.ndarray, leaves: np.ndarray) -> None:
            """Those of the chosen pairs of leaf and query whose bound still reaches the kth score; equal scores may win by a smaller id."""
            chosen = chosen[np.argsort(leaf[chosen], kind="stable")]
            ends = np.searchsorted(leaf[chosen], np.arange(len(left) + 1))
            for i in leaves:
                pairs = chosen[ends[i] : ends[i + 1]]
                who = at[pairs][up[pairs] >= np.maximum(floor[at[pairs]], score[at[pairs], -1])]
                if len(who):
                    _, _, a, b, _, _ = self.nodes[left[i][0]]
                    for j in range(a, b, 4 * LEAF):  # a leaf of equal rows may be large
                        self._leaf(j, min(b, j + 4 * LEAF), who, queries, own, k, floor, score, ident)

        for j in range(OWN_ORDER):
            visit(np.flatnonzero(nth == j), np.unique(leaf[nth == j]))
        visit(np.flatnonzero(nth >= OWN_ORDER), highest)
        return score, ident

    def _leaf(self, a, b, at, queries, own, k, floor, score, ident) -> None:
        s = scores(queries[at], self.rows[a:b])
        i = np.broadcast_to(self.ids[a:b], s.shape)
        s[(i == own[at][:, None]) | (s < floor[at][:, None])] = NONE
        s, i = np.concatenate([score[at], s], axis=1), np.concatenate([ident[at], i], axis=1)
        if s.shape[1] > 8 * k:  # rows that can't be among the best by score alone need no full sort
            kth = -np.partition(-np.maximum(s, NONE + 1), k - 1, axis=1)[:, k - 1]
            keep = (s >= kth[:, None]).any(axis=0)
            if keep.sum() < k:
                keep = np.ones(s.shape[1], bool)
            s, i = s[:, keep], i[:, keep]
        best = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
        score[at], ident[at] = np.take_along_axis(s, best, axis=1), np.take_along_axis(i, best, axis=1)


class Dealer:
    """Which part of space a vector of one length lies in: halves of a sample, halved again, ``parts`` in all."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.nodes: list[tuple] = []  # line, bound, left, right; or the number of a part
        self.centres: list[np.ndarray] = []
        self._split(sample, max(1, parts))

    def _split(self, sample: np.ndarray, parts: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if parts > 1 and len(sample) > 1:
            line, place = halves(sample)
            bound = float(np.median(place))
            right = place > bound
            if right.any():
                self.nodes[me] = (line, bound, self._split(sample[~right], parts - parts // 2), self._split(sample[right], parts // 2))
                return me
        self.nodes[me] = (len(self.centres),)
        self.centres.append(sample.mean(axis=0))
        return me

    def part(self, rows: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if len(self.nodes[node]) == 1:
                out[at] = self.nodes[node][0]
            elif len(at):
                line, bound, left, right = self.nodes[node]
                side = rows[at] @ line > bound
                stack += [(left, at[~side]), (right, at[side])]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _matrix(batch.column("v").take(pa.array(at)))


def _dealers(rows: DataFrame, parts: int) -> dict[int, Dealer]:
    """By length, from at most SAMPLE vectors chosen by a hash of their ids; lengths that aren't in it have one part about the origin."""
    seen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "v").collect():
        seen.setdefault(r.dim, []).append(r.v)
    return {dim: Dealer(np.array(v, np.float64), parts) for dim, v in seen.items()}


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, query_every: int = 50, shard_rows: int = 100_000, shard_bytes: int = 64 << 20, least_shards: int = 12, block: int = 512) -> DataFrame:
    """The ``k`` best rows for every row whose id is divisible by ``query_every``.

    In: ``vec_id``, ``embedding``; other columns are ignored, whatever their
    names. Components become floor(scale * x). Out: ``query_id``, ``rank`` from
    1, ``vec_id``, ``score``, ties to the smaller id. Null vectors, vectors with
    null or non-finite components, empty ones and null ids take no part;
    vectors meet only those of their own length. A repeated row is a candidate
    each time; a query doesn't match rows of its own id, and a repeated query
    is answered once. Scores are exact integers for all finite components; one
    beyond a long counts as the long's bound. An empty table gives none.

    Every row is in a shard; a part of space with more than ``shard_rows`` rows,
    or more than ``shard_bytes`` of components, is dealt to several by a hash,
    so the shard size bounds a task's memory, whatever the input, the length of
    its vectors and however alike its rows.
    """
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    most = float(np.finfo(np.float64).max) / scale
    scaled = F.transform("embedding", lambda x: scale * F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.size("embedding").alias("dim"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("dim").cast("long")).alias("b")).first()
    parts = max(least_shards, -(-total.n // shard_rows), -(-(total.b or 0) // shard_bytes))
    dealers = vectors.sparkSession.sparkContext.broadcast(_dealers(rows, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in _by_length(batch):
                v = np.floor(v)
                own = dealers.value.get(dim)
                part = own.part(v) if own else np.zeros(len(v), np.int64)
                centre = np.array(own.centres)[part] if own else np.zeros_like(v)
                away = np.sqrt(((v - centre) ** 2).sum(axis=1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), flat, pa.array(np.full(len(v), dim, np.int32)), pa.array(part), pa.array(away)], names=["vec_id", "v", "dim", "part", "away"])

    rows = materialise(rows.mapInArrow(deal, "vec_id long, v array<double>, dim int, part long, away double"), "topk-rows")
    # A row per part of space, of which there are `parts` a length of vectors.
    found = rows.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("dim", "part").collect()
    shards: dict[tuple[int, int], tuple[int, int, float]] = {}  # by length and part: the first shard, their number, the radius
    count = 0
    for r in found:
        shards[r.dim, r.part] = (count, -(-r.n // max(1, min(shard_rows, shard_bytes // (8 * r.dim)))), r.radius)
        count += shards[r.dim, r.part][1]
    plan = vectors.sparkSession.sparkContext.broadcast(shards)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [plan.value[x] for x in zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist())]
            shard = [first + (i * 0x9E3779B97F4A7C15 >> 20) % n for (first, n, _), i in zip(at, batch.column("vec_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(shard, pa.int64())], names=["vec_id", "v", "shard"])

    dealt = rows.mapInArrow(home, "vec_id long, v array<double>, shard long")
    candidates = dealt.select("shard", F.lit(0).alias("side"), "vec_id", "v", F.lit(NONE).alias("floor"))
    queries = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, tree, waiting = None, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if waiting and tree is not None:
                ids, q, floor = (np.concatenate(x) for x in zip(*waiting))
                for i in range(0, len(ids), block):
                    score, ident = tree.search(q[i : i + block], ids[i : i + block], k, floor[i : i + block])
                    r, c = np.nonzero(score > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + block][r]), pa.array(ident[r, c]), pa.array(score[r, c])], names=["query_id", "vec_id", "score"])
            waiting.clear()

        for batch in batches:
            key, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            cut = np.flatnonzero(np.diff(key * 2 + side)) + 1
            for a, b in zip([0, *cut], [*cut, len(key)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[a] != shard:
                    yield from answer()
                    shard, own, tree = key[a], [], None
                ids, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
                if side[a] == 0:
                    own.append((v, ids))
                    continue
                if tree is None and own:
                    tree, own = BallTree(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])), []
                waiting.append((ids, v, part.column("floor").to_numpy()))
                if sum(len(x[0]) for x in waiting) >= block:
                    yield from answer()
        yield from answer()

    def searched(asked: DataFrame) -> DataFrame:
        met = candidates.unionByName(asked.select("shard", F.lit(1).alias("side"), "vec_id", "v", "floor"))
        return met.repartition(max(1, count), "shard").sortWithinPartitions("shard", "side").mapInArrow(run, "query_id long, vec_id long, score long")

    first = materialise(searched(queries.mapInArrow(home, "vec_id long, v array<double>, shard long").withColumn("floor", F.lit(NONE))), "topk-first")
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NONE)).alias("floor"))
    asked = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "v", "dim", "part", F.coalesce("floor", F.lit(NONE)).alias("floor"))

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every shard but the query's own whose ball reaches its kth score so far."""
        for batch in batches:
            for dim, at, q in _by_length(batch):
                norms, ids, floor, own = np.sqrt((q**2).sum(axis=1)), *(batch.column(c).take(pa.array(at)).to_numpy() for c in ("vec_id", "floor", "part"))
                centres = dealers.value[dim].centres if dim in dealers.value else [np.zeros(dim)]
                vectors = batch.column("v").take(pa.array(at))
                for (d, part), (begin, n, radius) in plan.value.items():
                    if d != dim:
                        continue
                    able = reach(q, norms, centres[part], radius) >= floor
                    mine = np.where(own == part, begin + np.array([(i * 0x9E3779B97F4A7C15 >> 20) % n for i in ids.tolist()]), -1)
                    for shard in range(begin, begin + n):
                        go = np.flatnonzero(able & (mine != shard))
                        if len(go):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[go]), vectors.take(pa.array(go)), pa.array(np.full(len(go), shard)), pa.array(floor[go])], names=["vec_id", "v", "shard", "floor"])

    others = asked.mapInArrow(screened, "vec_id long, v array<double>, shard long, floor long")
    everything = materialise(first.union(searched(others)), "topk-all")
    discard(rows)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return everything.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
