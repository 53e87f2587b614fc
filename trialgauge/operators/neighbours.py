"""Exact k nearest neighbours of every point, without pairing all points.

1. Equal vectors collapse to one weighted vector, so copies cannot make a hot cell.
2. A kd-tree of median splits cuts space into leaves of a few thousand vectors. Leaves are
   counted and those above the limit are split again, each from a sample of its own, until
   none is. Samples only place the cuts; no result depends on them.
3. Leaves that hang together form blocks, so that small leaves do not make as many groups and
   trips. Inside its block each vector gets an upper bound on its k-th distance.
4. A vector descends the tree and visits only blocks with a leaf whose bounding box lies within
   that bound. Busy blocks are split over several tasks by a counted number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import drawn, top_per_group
from ..plans.staging import stage

LEAF_ROWS = 2048
#: Rows that place the cuts of one leaf, and the smallest number of them per new leaf.
SAMPLE_ROWS, PER_LEAF = 50_000, 16
_BLOCK = 512
#: Pairs of a vector and a leaf that a task looks at together.
_PAIRS = 1 << 18


def weighted_vectors(points: DataFrame) -> DataFrame:
    """``vid, vec, weight`` of distinct vectors; ``vid`` is the smallest member id."""
    return points.groupBy("vec").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("weight")).select("vid", "vec", "weight")


def _tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes ``(dim, cut, left, right)``; a leaf has dim -1 and its number in ``left``."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        spans = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        dim = int(np.argmax(spans))
        if want > 1 and len(rows) > 1 and spans[dim] > 0:
            cut = float(np.median(rows[:, dim]))
            low = rows[:, dim] <= cut
            if low.all():
                cut = float(np.mean(rows[:, dim]))
                low = rows[:, dim] <= cut
            left = grow(rows[low], want // 2)
            right = grow(rows[~low], want - want // 2)
            nodes[at] = (dim, cut, left, right)
        else:
            nodes[at] = (-1, 0.0, count, 0)
            count += 1
        return at

    grow(sample, leaves)
    return nodes


def _leaf_of(vecs: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(vecs), dtype=np.int64)
    stack = [(0, np.arange(len(vecs)))]
    while stack:
        at, rows = stack.pop()
        dim, cut, left, right = nodes[at]
        if dim < 0:
            out[rows] = left
            continue
        low = vecs[rows, dim] <= cut
        stack += [(left, rows[low]), (right, rows[~low])]
    return out


def grow_tree(vectors: DataFrame, leaf_rows: int) -> list[tuple[int, float, int, int]]:
    """Nodes of a tree none of whose leaves holds more than ``leaf_rows`` of the distinct ``vectors``.

    The driver holds the tree, two nodes per leaf; samples stay in the tasks, one bounded
    sample per leaf that is still too large.
    """
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    while True:
        placed = _placed(vectors, nodes)
        full = placed.groupBy("leaf").count().where(F.col("count") > leaf_rows)
        draw = F.xxhash64("vid")
        some = placed.join(full, "leaf").where(drawn(draw, SAMPLE_ROWS, F.col("count")))
        sampled = top_per_group(some, ["leaf"], [F.shiftrightunsigned(draw, 1).asc(), F.asc("vid")], SAMPLE_ROWS)

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = _matrix(pdf.sort_values("vid", kind="stable")["vec"])
            want = max(2, min(math.ceil(2 * pdf["count"].iloc[0] / leaf_rows), len(rows) // PER_LEAF))
            own = pd.DataFrame(_tree(rows, want), columns=["dim", "cut", "left", "right"])
            return own.assign(leaf=pdf["leaf"].iloc[0], at=range(len(own)))

        schema = "dim int, cut double, left int, right int, leaf long, at int"
        found = sampled.select("leaf", "vid", "vec", "count").groupBy("leaf").applyInPandas(split, schema).collect()
        if not found:
            return nodes
        nodes = _grafted(nodes, found)


def _grafted(nodes: list[tuple[int, float, int, int]], found: list) -> list[tuple[int, float, int, int]]:
    """The tree with its split leaves replaced by the subtrees that were found, leaves numbered anew."""
    subtrees: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["leaf"], r["at"])):
        subtrees.setdefault(r["leaf"], []).append(r)
    out = list(nodes)
    for at, (dim, _, leaf, _) in enumerate(nodes):
        if dim < 0 and leaf in subtrees:
            own = subtrees[leaf]
            # the subtree's root takes the leaf's place, its other nodes go to the end
            moved = [at, *range(len(out), len(out) + len(own) - 1)]
            out += [(-1, 0.0, 0, 0)] * (len(own) - 1)
            for r, place in zip(own, moved):
                inner = r["dim"] >= 0
                out[place] = (r["dim"], r["cut"], moved[r["left"]] if inner else 0, moved[r["right"]] if inner else 0)
    leaves = iter(range(len(out)))
    return [n if n[0] >= 0 else (-1, 0.0, next(leaves), 0) for n in out]


def _blocks(nodes: list[tuple[int, float, int, int]], leaf_rows: int) -> np.ndarray:
    """Block of every leaf: the largest subtrees of about as many leaves as there are blocks, and of ``LEAF_ROWS``
    vectors at most where a leaf has no more than that."""
    leaves: dict[int, list[int]] = {}
    stack = [(0, False)]
    while stack:
        at, done = stack.pop()
        dim, _, left, right = nodes[at]
        if dim < 0:
            leaves[at] = [left]
        elif done:
            leaves[at] = leaves[left] + leaves[right]
        else:
            stack += [(at, True), (left, False), (right, False)]
    most = max(1, min(math.isqrt(len(leaves[0])), LEAF_ROWS // leaf_rows))
    block, count, stack = np.zeros(len(leaves[0]), dtype=np.int64), 0, [0]
    while stack:
        at = stack.pop()
        if len(leaves[at]) <= most:
            block[leaves[at]] = count
            count += 1
        else:
            stack += nodes[at][2:]
    return block


def _placed(vectors: DataFrame, nodes: list[tuple[int, float, int, int]]) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(nodes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=_leaf_of(_matrix(pdf["vec"]), shared.value))

    return vectors.select("vid", "vec", "weight").mapInPandas(place, "vid string, vec array<double>, weight long, leaf long")


def _reached(vecs: np.ndarray, bound: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row and leaf such that the leaf's side of every cut lies within the row's bound."""
    rows_out, leaves_out = [], []
    stack = [(0, np.arange(len(vecs)))]
    while stack:
        at, rows = stack.pop()
        if not len(rows):
            continue
        dim, cut, left, right = nodes[at]
        if dim < 0:
            rows_out.append(rows)
            leaves_out.append(np.full(len(rows), left))
            continue
        x, b = vecs[rows, dim], bound[rows]
        stack += [(left, rows[x - b <= cut]), (right, rows[x + b > cut])]
    return np.concatenate(rows_out or [np.zeros(0, int)]), np.concatenate(leaves_out or [np.zeros(0, int)])


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _nearest(queries: pd.DataFrame, base: pd.DataFrame, k: int) -> pd.DataFrame:
    """Closest ``k`` base vectors of each query (ties by id), self included at zero."""
    base = base.sort_values("vid", kind="stable")
    b_vec, b_id, b_w = _matrix(base["vec"]), base["vid"].to_numpy(), base["weight"].to_numpy()
    out = []
    for at in range(0, len(queries), _BLOCK):
        part = queries.iloc[at : at + _BLOCK]
        d = _distances(_matrix(part["vec"]), b_vec)
        keep = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        rows = np.repeat(np.arange(len(part)), keep.shape[1])
        cols = keep.ravel()
        out.append(
            pd.DataFrame(
                {"vid": part["vid"].to_numpy()[rows], "nid": b_id[cols], "distance": d[rows, cols], "weight": b_w[cols]}
            )
        )
    if not out:
        return pd.DataFrame({"vid": [], "nid": [], "distance": [], "weight": []})
    return pd.concat(out, ignore_index=True)


_NEAR = "vid string, nid string, distance double, weight long"


def nearest(vectors: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``vid, nid, distance, weight, rank`` of the ``k + 1`` closest vectors, self first.

    ``vectors(vid, vec, weight)`` should be staged. Weights count copies, so ``k``
    neighbours in the sense of points are always among the listed vectors.
    """
    nodes = grow_tree(vectors, leaf_rows)
    block_of = _blocks(nodes, leaf_rows)
    places = vectors.sparkSession.sparkContext.broadcast((nodes, block_of))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, blocks = places.value
        for pdf in batches:
            leaf = _leaf_of(_matrix(pdf["vec"]), tree)
            yield pdf.assign(leaf=leaf, block=blocks[leaf])

    schema = "vid string, vec array<double>, weight long, leaf long, block long"
    placed = stage(vectors.select("vid", "vec", "weight").mapInPandas(place, schema), "leaves")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf, pdf, k)

    local = placed.groupBy("block").applyInPandas(within, _NEAR)
    if block_of.max() == 0:
        return _ranked(local, k)
    local = stage(local, "near")
    bound = local.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    bound = bound.select("vid", F.when(F.col("n") > k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))

    dims = len(placed.select("vec").first()["vec"])
    boxes = placed.groupBy("leaf").agg(
        F.array(*[F.min(F.col("vec")[i]) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("vec")[i]) for i in range(dims)]).alias("hi"),
    ).collect()  # one row per leaf, as many as the tree that the driver holds
    lo, hi = np.full((len(block_of), dims), np.inf), np.full((len(block_of), dims), -np.inf)
    for b in boxes:
        lo[b["leaf"]], hi[b["leaf"]] = b["lo"], b["hi"]
    shared = vectors.sparkSession.sparkContext.broadcast((nodes, block_of, lo, hi))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, blocks, low, high = shared.value
        step = max(1, _PAIRS // len(blocks))
        for whole in batches:
            for at in range(0, len(whole), step):
                pdf = whole.iloc[at : at + step]
                v, bound_of, own = _matrix(pdf["vec"]), pdf["bound"].to_numpy(), pdf["block"].to_numpy()
                r, c = _reached(v, bound_of, tree)
                gap = np.sqrt((np.maximum(0, np.maximum(low[c] - v[r], v[r] - high[c])) ** 2).sum(axis=1))
                hit = (gap <= bound_of[r]) & (blocks[c] != own[r])
                r, c = np.unique(np.stack([r[hit], blocks[c[hit]]]), axis=1)
                yield pd.DataFrame({"vid": pdf["vid"].to_numpy()[r], "vec": pdf["vec"].to_numpy()[r], "target": c})

    trips = placed.join(bound, "vid").mapInPandas(visits, "vid string, vec array<double>, target long")
    trips = stage(trips, "visits")
    load = trips.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / max(leaf_rows, LEAF_ROWS)).cast("int").alias("copies"))
    asked = trips.join(load, "target").withColumn("copy", F.pmod(F.xxhash64("vid"), F.col("copies")).cast("int"))
    asked = asked.select("vid", "vec", F.lit(1).cast("long").alias("weight"), "target", "copy")
    held = placed.withColumnRenamed("block", "target").join(load, "target").select(
        "vid", "vec", "weight", "target", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )

    def across(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest(q, b, k)

    remote = asked.groupBy("target", "copy").cogroup(held.groupBy("target", "copy")).applyInPandas(across, _NEAR)
    return _ranked(local.unionByName(remote), k)


def bridges(points: DataFrame, asking: DataFrame, eps: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``u, v``: pairs of different components with two points at most ``eps`` apart.

    ``points(vid, vec, component)`` are distinct vectors, ``asking`` some of them. An asking
    point visits the leaves whose boxes lie within ``eps`` of it; busy leaves are split as in
    ``nearest``. A task puts out pairs of components, never of points.
    """
    nodes = grow_tree(points.withColumn("weight", F.lit(1).cast("long")), leaf_rows)
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def leaves(reach: float):
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                r, c = _reached(_matrix(pdf["vec"]), np.full(len(pdf), reach), tree.value)
                yield pdf.iloc[r].assign(target=c)

        return place

    schema = "vid string, vec array<double>, component string, target long"
    rows = lambda df: df.select("vid", "vec", "component")
    trips = stage(rows(asking).mapInPandas(leaves(eps), schema), "visits")
    load = trips.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64("vid"), F.col("copies")).cast("int").alias("copy")
    asked = trips.join(load, "target").select("vid", "vec", "component", "target", copy)
    own = _placed(points.withColumn("weight", F.lit(1).cast("long")), nodes).select("vid", F.col("leaf").alias("target"))
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    held = rows(points).join(own, "vid").join(load, "target").select("vid", "vec", "component", "target", every)

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[str, str]] = set()
        x, y = _matrix(q["vec"]), _matrix(b["vec"])
        u, v = q["component"].to_numpy(), b["component"].to_numpy()
        for at in range(0, len(q) if len(b) else 0, _BLOCK):
            near = (_distances(x[at : at + _BLOCK], y) <= eps) & (u[at : at + _BLOCK, None] != v[None, :])
            r, c = np.nonzero(near)
            found |= set(zip(u[at + r], v[c]))
        return pd.DataFrame(sorted(found), columns=["u", "v"])

    pairs = asked.groupBy("target", "copy").cogroup(held.groupBy("target", "copy")).applyInPandas(meet, "u string, v string")
    return pairs.distinct()


def nearest_outside(points: DataFrame, asking: DataFrame, nodes: list[tuple[int, float, int, int]], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``component, edge``: for each component of ``asking(vid, vec, component, reach)`` the shortest edge ``(w, u, v)``
    to a point of ``points(vid, vec, component)`` in another component, no longer than a point's ``reach``.

    Equal lengths are ordered by their ends. ``nodes`` is a tree over the points; busy leaves are split
    as in ``nearest``. A task puts out one edge per component, never pairs of points.
    """
    tree = points.sparkSession.sparkContext.broadcast(nodes)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, c = _reached(_matrix(pdf["vec"]), pdf["reach"].to_numpy(float), tree.value)
            yield pdf.iloc[r].assign(target=c)

    rows = lambda df, *more: df.select("vid", "vec", "component", *more)
    trips = stage(rows(asking, "reach").mapInPandas(leaves, "vid string, vec array<double>, component string, reach double, target long"), "visits")
    load = trips.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).cast("int").alias("copies"))
    copy = F.pmod(F.xxhash64("vid"), F.col("copies")).cast("int").alias("copy")
    asked = trips.join(load, "target").select("vid", "vec", "component", "reach", "target", copy)
    own = _placed(points.withColumn("weight", F.lit(1).cast("long")), nodes).select("vid", F.col("leaf").alias("target"))
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    held = rows(points).join(own, "vid").join(load, "target").select("vid", "vec", "component", "target", every)

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best: dict[str, tuple[float, str, str]] = {}
        x, y = _matrix(q["vec"]), _matrix(b["vec"])
        u, v, uid, vid, reach = q["component"].to_numpy(), b["component"].to_numpy(), q["vid"].to_numpy(), b["vid"].to_numpy(), q["reach"].to_numpy(float)
        for at in range(0, len(q) if len(b) else 0, _BLOCK):
            gap = np.where(u[at : at + _BLOCK, None] != v[None, :], _distances(x[at : at + _BLOCK], y), np.inf)
            least = gap.min(axis=1)
            r, c = np.nonzero((gap == least[:, None]) & np.isfinite(gap) & (gap <= reach[at : at + _BLOCK, None]))
            for i, j in zip(r, c):
                edge = (float(gap[i, j]), *sorted((uid[at + i], vid[j])))
                best[u[at + i]] = min(best.get(u[at + i], edge), edge)
        return pd.DataFrame([(k, *e) for k, e in best.items()], columns=["component", "w", "u", "v"])

    found = asked.groupBy("target", "copy").cogroup(held.groupBy("target", "copy")).applyInPandas(meet, "component string, w double, u string, v string")
    return found.groupBy("component").agg(F.min(F.struct("w", "u", "v")).alias("edge"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    self_first = (F.col("vid") != F.col("nid")).cast("int")
    return top_per_group(rows, ["vid"], [self_first.asc(), F.asc("distance"), F.asc("nid")], k + 1)


def effective_neighbours(near: DataFrame, k: int) -> DataFrame:
    """Neighbours counted with copies until ``k`` points are reached.

    A vector's own copies come first. Adds ``take``, the number of points each listed
    vector supplies. Groups hold at most ``k + 1`` rows.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("vid").orderBy("rank")
    available = F.col("weight") - (F.col("vid") == F.col("nid")).cast("long")
    before = F.coalesce(F.sum(available).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.least(available, F.lit(k) - before)
    return near.withColumn("take", take).where(F.col("take") > 0)


def local_outlier_factor(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``id, lof`` (Breunig et al., 2000) for ``points(id, vec)``; self is excluded."""
    pts = stage(points, "points")
    vectors = stage(weighted_vectors(pts), "vectors")
    near = stage(effective_neighbours(nearest(vectors, k, leaf_rows), k), "near")
    k_dist = near.groupBy("vid").agg(F.max("distance").alias("k_distance"))
    reach = near.join(k_dist.withColumnRenamed("vid", "nid"), "nid")
    density = stage(
        reach.groupBy("vid").agg(
            (F.sum("take") / (F.sum(F.col("take") * F.greatest("k_distance", "distance")) + F.lit(1e-10) * F.sum("take"))).alias("lrd")
        ),
        "density",
    )
    peers = near.join(density.select(F.col("vid").alias("nid"), F.col("lrd").alias("peer_lrd")), "nid")
    factor = peers.groupBy("vid").agg((F.sum(F.col("take") * F.col("peer_lrd")) / F.sum("take")).alias("mean_lrd"))
    scored = vectors.join(density, "vid").join(factor, "vid").select("vec", (F.col("mean_lrd") / F.col("lrd")).alias("lof"))
    return pts.join(scored, "vec").select("id", "lof")
