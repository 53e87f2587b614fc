"""Site clustering: density, mixtures, consensus, profiles and quality measures.

``points(id, vec)`` are scaled features (see ``anomalies.scaled_vectors``); ``labels(id,
cluster)`` assign them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import fixed
from ..plans.ordering import top_per_group
from ..plans.staging import stage
from .components import connected_components
from .joins import attach_scalars
from .neighbours import LEAF_ROWS, bridges, effective_neighbours, grow_tree, nearest, nearest_outside, weighted_vectors

SEED, RESTARTS = 42, 10
GMM_RESTARTS = 5
EPS, MIN_POINTS = 2.0, 3
MAX_CLUSTERS = 10
SPECTRAL_NEIGHBOURS = 10
_LINKS = 8
#: Label tuples whose distances fit into a task: 400 MB.
MAX_TUPLES = 10_000
_BLOCK_ROWS = 2048

# Low, medium, high bounds per metric.
RISK_BOUNDS = {
    "missing_visits_pct": (0.05, 0.15, 0.30),
    "missing_pages_pct": (0.05, 0.15, 0.30),
    "open_issues_per_subject": (1.0, 3.0, 5.0),
    "safety_pending_pct": (0.05, 0.15, 0.30),
}


# ---- density clusters ----


def eps_components(vectors: DataFrame, near: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """``id, component`` of core vectors linked by distance ≤ ``eps``; exact.

    The nearest-neighbour lists link almost everything. What they leave apart can only be
    joined by a pair from two different components, so the final check sends the points of
    all but the largest component to the leaves of the neighbour tree within ``eps``.
    """
    links = (
        near.where((F.col("vid") != F.col("nid")) & (F.col("distance") <= eps))
        .join(core.select("vid"), "vid", "left_semi")
        .join(core.select(F.col("vid").alias("nid")), "nid", "left_semi")
        .select(F.col("vid").alias("u"), F.col("nid").alias("v"))
    )
    part = stage(connected_components(core.select(F.col("vid").alias("id")), links), "parts")
    if part.select("component").distinct().limit(2).count() < 2:
        return part
    placed = part.join(vectors.select(F.col("vid").alias("id"), "vec"), "id")
    placed = stage(placed.select(F.col("id").alias("vid"), "vec", "component"), "placed")
    # only the smaller components ask; the largest is the one being asked
    largest = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    links = bridges(placed, placed.join(largest, "component", "left_anti"), eps)
    merged = connected_components(part.select(F.col("component").alias("id")).distinct(), links)
    return part.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component").select(
        "id", F.col("whole").alias("component")
    )


def dbscan(points: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """``id, cluster``; noise is -1, clusters are numbered by their smallest core id.

    A point is core when its ``min_points - 1``-th neighbour lies within ``eps``, so no
    neighbourhood is ever listed in full. A non-core point has fewer neighbours than that,
    all of them on its list; it takes the cluster of the smallest core id among them.
    """
    pts = stage(points, "points")
    vectors = stage(weighted_vectors(pts), "vectors")
    near = stage(nearest(vectors, max(min_points - 1, _LINKS)), "near")
    need = min_points - 1
    if need > 0:
        taken = effective_neighbours(near, need).groupBy("vid").agg(F.sum("take").alias("n"), F.max("distance").alias("far"))
        core = taken.where((F.col("n") >= need) & (F.col("far") <= eps)).select("vid")
    else:
        core = vectors.select("vid")
    core = stage(core, "core")
    parts = stage(eps_components(vectors, near, core, eps), "parts")
    border = (
        near.where(F.col("distance") <= eps)
        .join(core, "vid", "left_anti")
        .join(parts.select(F.col("id").alias("nid"), "component"), "nid")
        .groupBy("vid")
        .agg(F.min(F.struct("nid", "component")).alias("m"))
        .select(F.col("vid").alias("id"), F.col("m.component").alias("component"))
    )
    by_vector = parts.unionByName(border)
    members = pts.join(vectors, "vec").join(by_vector.withColumnRenamed("id", "vid"), "vid", "left").select("id", "component")
    return numbered(members)


def numbered(members: DataFrame) -> DataFrame:
    """Replace component ids by 0, 1, … in id order; null becomes -1."""
    from ..plans.ordering import with_position

    names = stage(members.where(F.col("component").isNotNull()).select("component").distinct(), "names")
    order = with_position(names, [F.asc("component")], name="n", total=None)
    return members.join(order, "component", "left").select("id", F.coalesce(F.col("n") - 1, F.lit(-1)).cast("int").alias("cluster"))


def single_linkage(points: DataFrame, distance: float) -> DataFrame:
    """Exact single-linkage clusters at a distance cut: components of the eps graph."""
    return dbscan(points, eps=distance, min_points=1)


# ---- merge tree ----


def merge_tree(points: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """``members(id, vid)`` and ``merges(rank, height, u, v)``: the merges of single linkage, lowest first.

    They are the edges of the shortest spanning tree over distinct vectors (Borůvka, 1926): in a
    round every component takes its shortest edge to another one, so at most log2 of the vectors
    many rounds are needed. Most edges come from the nearest-neighbour lists. A point whose list stays inside
    its component and ends below the component's best edge looks further, as far as that
    edge. Edges of one length are ordered by their ends, which keeps the tree free of circles. One
    tree answers every cut: ``cut_at`` a distance or ``cut_into`` a number of clusters.
    """
    pts = stage(points, "points")
    vectors = stage(weighted_vectors(pts), "vectors")
    members = pts.join(vectors.select("vid", "vec"), "vec").select("id", "vid")
    nodes = grow_tree(vectors, leaf_rows)
    listed = stage(nearest(vectors, _LINKS, leaf_rows).where(F.col("vid") != F.col("nid")).select("vid", "nid", "distance"), "near")
    # a list that is all there is leaves nothing to look for
    far = listed.groupBy("vid").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    part = stage(vectors.select("vid", F.col("vid").alias("component")), "parts")
    edges = None
    edge = F.struct(F.col("distance").alias("w"), F.least("vid", "nid").alias("u"), F.greatest("vid", "nid").alias("v"))
    while part.select("component").distinct().limit(2).count() > 1:
        other = part.select(F.col("vid").alias("nid"), F.col("component").alias("there"))
        out = listed.join(part, "vid").join(other, "nid").where(F.col("component") != F.col("there"))
        ends = stage(out.groupBy("component").agg(F.min(edge).alias("edge")), "edges")
        placed = stage(vectors.select("vid", "vec").join(part, "vid"), "placed")
        # a component that no list leaves reaches as far as one known point outside
        two = placed.orderBy("vid").limit(1).unionByName(placed.join(placed.agg(F.min_by("component", "vid").alias("first")), F.col("component") != F.col("first")).drop("first").orderBy("vid").limit(1))
        two = two.select(F.col("component").alias("there"), F.col("vec").alias("outside"))
        gap = F.sqrt(F.aggregate(F.zip_with("vec", "outside", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        first = placed.groupBy("component").agg(F.min_by("vec", "vid").alias("vec"))
        known = first.join(F.broadcast(two), F.col("component") != F.col("there")).groupBy("component").agg(F.min(gap).alias("gap"))
        bound = known.join(ends, "component", "left").select("component", F.coalesce("edge.w", F.col("gap") * (1 + 1e-9)).alias("reach"))
        stays = out.select("vid").distinct()
        asking = placed.join(stays, "vid", "left_anti").join(far, "vid", "left").join(bound, "component")
        asking = stage(asking.where((F.coalesce("n", F.lit(0)) >= _LINKS) & (F.col("far") <= F.col("reach"))).select("vid", "vec", "component", "reach"), "asking")
        if not asking.isEmpty():
            more = nearest_outside(placed, asking, nodes, leaf_rows)
            ends = stage(ends.unionByName(more).groupBy("component").agg(F.min("edge").alias("edge")), "edges")
        new = ends.select("edge.*").distinct()
        edges = new if edges is None else edges.unionByName(new)
        across = new.join(part.select(F.col("vid").alias("u"), F.col("component").alias("a")), "u").join(part.select(F.col("vid").alias("v"), F.col("component").alias("b")), "v")
        names = part.select(F.col("component").alias("id")).distinct()
        joined = connected_components(names, across.select(F.col("a").alias("u"), F.col("b").alias("v")))
        part = stage(part.join(joined.withColumnRenamed("component", "whole"), F.col("component") == F.col("id")).select("vid", F.col("whole").alias("component")), "parts")
    from ..plans.ordering import with_position

    if edges is None:
        edges = pts.sparkSession.createDataFrame([], "w double, u string, v string")
    ranked = with_position(stage(edges.distinct(), "tree"), [F.asc("w"), F.asc("u"), F.asc("v")], name="rank", total=None)
    return members, stage(ranked.select("rank", F.col("w").alias("height"), "u", "v"), "merges")


def _cut(members: DataFrame, merges: DataFrame) -> DataFrame:
    parts = connected_components(members.select(F.col("vid").alias("id")).distinct(), merges.select("u", "v"))
    return numbered(members.join(parts.withColumnRenamed("id", "vid"), "vid").select("id", "component"))


def cut_at(tree: tuple[DataFrame, DataFrame], distance: float) -> DataFrame:
    """``id, cluster`` of single linkage at a distance."""
    members, merges = tree
    return _cut(members, merges.where(F.col("height") <= distance))


def cut_into(tree: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """``id, cluster`` of single linkage with ``k`` clusters, or as many as there are distinct vectors."""
    members, merges = tree
    n = members.select("vid").distinct().count()
    return _cut(members, merges.where(F.col("rank") <= n - k))


# ---- MLlib models ----


def _vectors(points: DataFrame) -> DataFrame:
    return points.select("id", array_to_vector("vec").alias("features"))


def kmeans(points: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Best of several seeded starts by training cost."""
    data = stage(points, "points")
    rows = _vectors(data)
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, maxIter=50).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(rows).select("id", F.col("prediction").alias("cluster"))


def bisecting(points: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Top-down hierarchical clusters, in place of quadratic agglomeration.

    Scaled points are centred on zero, and the model separates the first two centres by
    noise proportional to the centre's norm; a shift, which no distance notices, gives it
    one.
    """
    rows = _vectors(stage(points, "points").select("id", F.transform("vec", lambda x: x + 10.0).alias("vec")))
    model = BisectingKMeans(k=k, seed=seed, maxIter=50).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def _live_dimensions(points: DataFrame) -> DataFrame:
    """Drop constant coordinates, which have no density."""
    dims = points.select(F.posexplode("vec").alias("dim", "v")).groupBy("dim").agg(F.stddev_pop("v").alias("s"))
    keep = sorted(r["dim"] for r in dims.collect() if r["s"] and r["s"] > 1e-12)
    return points.select("id", F.array(*[F.col("vec")[i] for i in keep]).alias("vec"))


def _fit_mixture(rows: DataFrame, k: int, restarts: int, seed: int):
    best = None
    for i in range(restarts):
        model = GaussianMixture(k=k, seed=seed + i, maxIter=100, tol=1e-3).fit(rows)
        if best is None or model.summary.logLikelihood > best.summary.logLikelihood:
            best = model
    return best


def fit_mixture(points: DataFrame, k: int, restarts: int = GMM_RESTARTS, seed: int = SEED):
    """The model itself, to be saved and used on other points (all coordinates are kept)."""
    return _fit_mixture(with_features(stage(points, "points")), k, restarts, seed)


def with_features(points: DataFrame) -> DataFrame:
    return _vectors(points)


def gaussian_mixture(points: DataFrame, k: int, restarts: int = GMM_RESTARTS, seed: int = SEED) -> DataFrame:
    """``id, cluster, probabilities``."""
    rows = _vectors(stage(_live_dimensions(points), "points"))
    model = _fit_mixture(rows, k, restarts, seed)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"), vector_to_array("probability").alias("probabilities"))


def spectral(points: DataFrame, k: int, neighbours: int = SPECTRAL_NEIGHBOURS) -> DataFrame:
    """Power iteration clustering on the nearest-neighbour graph of distinct vectors."""
    from ..plans.ordering import with_position

    pts = stage(points, "points")
    vectors = stage(weighted_vectors(pts), "vectors")
    numbers = stage(with_position(vectors.select("vid"), [F.asc("vid")], name="no", total=None), "numbers")
    near = nearest(vectors, neighbours).where(F.col("vid") != F.col("nid"))
    pairs = (
        near.join(numbers, "vid").withColumnRenamed("no", "src")
        .join(numbers.select(F.col("vid").alias("nid"), F.col("no").alias("dst")), "nid")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    )
    found = PowerIterationClustering(k=k, maxIter=40, weightCol="weight").assignClusters(stage(pairs, "pairs"))
    by_vid = numbers.join(found, numbers.no == found.id).select("vid", F.col("cluster"))
    missing = F.raise_error(F.concat(F.lit("no spectral label for "), F.col("vid")))
    return pts.join(vectors, "vec").join(by_vid, "vid", "left").select("id", F.coalesce("cluster", missing.cast("int")).alias("cluster"))


def silhouette_squared(points: DataFrame, labels: DataFrame) -> float:
    rows = _vectors(points).join(labels.select("id", F.col("cluster").cast("int").alias("prediction")), "id")
    return ClusteringEvaluator(featuresCol="features").evaluate(rows)


def silhouette_scores(points: DataFrame, max_k: int = MAX_CLUSTERS, restarts: int = RESTARTS) -> dict[int, float]:
    """Silhouette of the k-means clusters for each k from two on."""
    pts = stage(points, "points")
    top = min(max_k, pts.count() - 1)
    return {k: silhouette_squared(pts, kmeans(pts, k, restarts)) for k in range(2, top + 1)}


def best_k_by_silhouette(points: DataFrame, max_k: int = MAX_CLUSTERS, restarts: int = RESTARTS) -> int:
    """Smallest k with the best silhouette; fewer than three points give two."""
    scores = silhouette_scores(points, max_k, restarts)
    return max(scores, key=lambda k: (scores[k], -k)) if scores else 2


def mixture_bic(log_likelihood: float, k: int, dims: int, n: int) -> float:
    free = k - 1 + k * dims + k * dims * (dims + 1) / 2
    return free * math.log(n) - 2 * log_likelihood


def bic_scores(points: DataFrame, max_k: int = MAX_CLUSTERS, seed: int = SEED) -> dict[int, float]:
    """Information criterion of the mixture for each k from two on."""
    live = stage(_live_dimensions(points), "points")
    n, dims = live.count(), len(live.first()["vec"])
    rows = _vectors(live)
    return {k: mixture_bic(_fit_mixture(rows, k, 1, seed).summary.logLikelihood, k, dims, n) for k in range(2, min(max_k, n - 1) + 1)}


def best_k_by_bic(points: DataFrame, max_k: int = MAX_CLUSTERS, seed: int = SEED) -> int:
    scores = bic_scores(points, max_k, seed)
    return min(scores, key=lambda k: (scores[k], k)) if scores else 2


# ---- consensus ----


def co_association(labelings: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(id, key)`` and ``(key, labels, size)``: points with equal label tuples are one.

    There are at most k^m tuples for m labelings of k clusters, whatever the number of
    points.
    """
    joined = None
    for i, df in enumerate(labelings):
        col = df.select("id", F.col("cluster").cast("int").alias(f"l{i}"))
        joined = col if joined is None else joined.join(col, "id")
    names = [f"l{i}" for i in range(len(labelings))]
    keyed = stage(joined.select("id", F.concat_ws("|", *names).alias("key"), F.array(*names).alias("labels")), "tuples")
    return keyed.select("id", "key"), keyed.groupBy("key", "labels").agg(F.count(F.lit(1)).alias("size"))


def co_association_pairs(tuples: DataFrame) -> DataFrame:
    """Share of methods that put two label tuples together, from equal labels only."""
    rows = tuples.select("key", F.size("labels").alias("m"), F.posexplode("labels").alias("method", "label"))
    other = rows.select(F.col("key").alias("other"), "method", "label")
    same = rows.join(other, ["method", "label"]).groupBy("key", "other", "m").agg(F.count(F.lit(1)).alias("n"))
    return same.select("key", "other", (F.col("n") / F.col("m")).alias("share"))


def _average_linkage(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Size-weighted average linkage by nearest-neighbour chains, in quadratic time.

    Average linkage never brings a merged pair closer to the rest, so chains find the same
    merges as a search for the closest pair; they are then applied in order of distance.
    """
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    labels, size = np.stack(pdf["labels"].to_numpy()), pdf["size"].to_numpy(dtype=float)
    n = len(pdf)
    dist = np.zeros((n, n), np.float32)
    for column in labels.T:
        dist += column[:, None] != column[None, :]
    dist /= labels.shape[1]
    np.fill_diagonal(dist, np.inf)
    alive = np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        top = chain[-1]
        near = int(np.argmin(dist[top]))
        # on a tie the chain goes back, so that it ends
        if len(chain) > 1 and dist[top, chain[-2]] <= dist[top, near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        del chain[-2:]
        a, b = min(top, near), max(top, near)
        merges.append((float(dist[a, b]), a, b))
        merged = (size[a] * dist[a] + size[b] * dist[b]) / (size[a] + size[b])
        dist[a], dist[:, a] = merged, merged
        dist[b], dist[:, b] = np.inf, np.inf
        dist[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    owner = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        owner[owner == owner[b]] = owner[a]
    numbers = {o: i for i, o in enumerate(dict.fromkeys(owner))}
    return pd.DataFrame({"key": pdf["key"], "cluster": [numbers[o] for o in owner]})


def consensus(labelings: Sequence[DataFrame], k: int) -> DataFrame:
    """Size-weighted average linkage over the label tuples, cut to ``k``.

    Equal tuples would merge at distance zero first, so working on tuples is exact. The
    one group holds at most k^m rows; their number is measured, and more than its matrix
    of distances has room for is an error.
    """
    points, tuples = co_association(labelings)
    tuples = stage(tuples, "tuples")
    if (n := tuples.count()) > MAX_TUPLES:
        raise ValueError(f"{n} label tuples; their distances need more than the room for {MAX_TUPLES}")
    rows = tuples.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(
        lambda pdf: _average_linkage(pdf, k), "key string, cluster int"
    )
    return points.join(rows, "key").select("id", "cluster")


def ensemble(points: DataFrame, k: int, restarts: int = RESTARTS) -> DataFrame:
    """Consensus of hierarchical, k-means, mixture and spectral clusters."""
    pts = stage(points, "points")
    runs = [bisecting(pts, k), kmeans(pts, k, restarts), gaussian_mixture(pts, k, 1).select("id", "cluster"), spectral(pts, k)]
    return consensus(runs, k)


# ---- profiles ----


def group_profile(features: DataFrame, labels: DataFrame, metrics: Sequence[str], key: str = "site_id") -> DataFrame:
    """Size and means per label; unlabeled sites drop out."""
    rows = features.join(labels.withColumnRenamed("id", key), key).where(F.col("cluster").isNotNull())
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics])


def cluster_risk() -> Column:
    """Mean of four metric grades (0 to 3) as a level, over columns named like metrics."""
    total = None
    for m, (low, medium, high) in RISK_BOUNDS.items():
        v = F.col(m)
        grade = F.when(v >= high, 3).when(v >= medium, 2).when(v >= low, 1).otherwise(0)
        total = grade if total is None else total + grade
    mean = total / len(RISK_BOUNDS)
    return F.when(mean >= 2.5, "Critical").when(mean >= 1.5, "High").when(mean >= 0.5, "Medium").otherwise("Low")


# The limits and phrases of the description.
def cluster_description(risk: Column) -> Column:
    # summation noise must not move a printed digit
    mv, oi, sp = (F.round(F.col(c), 9) for c in ("missing_visits_pct", "open_issues_per_subject", "safety_pending_pct"))
    phrases = F.array_compact(
        F.array(
            F.when(mv > 0.15, F.concat(F.lit("high missing visits ("), fixed(mv * 100, 1), F.lit("%)"))).when(
                mv < 0.05, "excellent visit compliance"
            ),
            F.when(oi > 3, F.concat(F.lit("high issue count ("), fixed(oi, 1), F.lit("/subject)"))).when(oi < 1, "low issue burden"),
            F.when(sp > 0.1, F.concat(F.lit("pending safety reviews ("), fixed(sp * 100, 1), F.lit("%)"))),
        )
    )
    some = F.concat(risk, F.lit(" risk cluster: "), F.concat_ws(", ", phrases))
    return F.when(F.size(phrases) > 0, some).otherwise(F.concat(risk, F.lit(" risk cluster with average performance")))


def cluster_profiles(features: DataFrame, labels: DataFrame, metrics: Sequence[str], key: str = "site_id") -> DataFrame:
    """Size, centroid, sample deviations, risk and description per cluster."""
    rows = features.join(labels.withColumnRenamed("id", key), key)
    sums = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(m).alias(m) for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
    )
    sums = sums.withColumn("risk_level", cluster_risk())
    sums = sums.withColumn("description", cluster_description(F.col("risk_level")))
    return sums.withColumns({c: F.round(c, 4) for m in metrics for c in (m, f"{m}_std")})


def representatives(features: DataFrame, labels: DataFrame, metrics: Sequence[str], k: int = 3, key: str = "site_id") -> DataFrame:
    """Sites nearest to their cluster's rounded centroid, unscaled."""
    rows = features.join(labels.withColumnRenamed("id", key), key)
    centre = rows.groupBy("cluster").agg(*[F.round(F.avg(m), 4).alias(f"c_{m}") for m in metrics])
    gap = F.lit(0.0)
    for m in metrics:
        gap = gap + (F.col(m) - F.col(f"c_{m}")) * (F.col(m) - F.col(f"c_{m}"))
    near = rows.join(centre, "cluster").withColumn("distance", F.round(F.sqrt(gap), 9))
    return top_per_group(near.select("cluster", key, "distance"), ["cluster"], [F.asc("distance"), F.asc(key)], k)


# ---- quality ----


def silhouette(points: DataFrame, labels: DataFrame, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette per point: ``id, cluster, silhouette``.

    Quadratic in points by definition. Work is split into block pairs that return one
    distance sum per point and cluster, never a pair of points.
    """
    rows = stage(points.join(labels, "id").select("id", "vec", F.col("cluster").cast("int").alias("cluster")), "labeled")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = rows.withColumn("a", block).withColumn("b", others)
    held = rows.withColumn("b", block).withColumn("a", others)

    def sums(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "total": []})
        x, y = np.stack(q["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
        names = np.unique(b["cluster"].to_numpy())
        member = (b["cluster"].to_numpy()[:, None] == names[None, :]).astype(float)
        total = np.vstack(
            [np.sqrt(((x[i : i + 256, None, :] - y[None]) ** 2).sum(axis=2)) @ member for i in range(0, len(x), 256)]
        )
        return pd.DataFrame(
            {
                "id": np.repeat(q["id"].to_numpy(), len(names)),
                "cluster": np.repeat(q["cluster"].to_numpy(), len(names)),
                "other": np.tile(names, len(q)),
                "total": total.ravel(),
            }
        )

    part = asking.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInPandas(sums, "id string, cluster int, other int, total double")
    sizes = rows.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    per = part.groupBy("id", "cluster", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own = F.col("other") == F.col("cluster")
    both = per.groupBy("id", "cluster").agg(
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("outside"),
    )
    value = (F.col("outside") - F.col("inside")) / F.greatest("inside", "outside")
    return both.select("id", "cluster", F.coalesce(F.when(F.col("inside").isNull(), 0.0).otherwise(value), F.lit(0.0)).alias("silhouette"))


def squared_silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Squared-Euclidean silhouette per point: ``id, cluster, silhouette``, in one pass.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum of
    vectors and sum of squared norms, so k small rows stand for all points.
    """
    rows = stage(points.join(labels, "id").select("id", "vec", F.col("cluster").cast("int").alias("cluster")), "labeled")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("norm", dot("vec", "vec"))
    first = rows.select("vec").first()
    dims = len(first["vec"]) if first else 0
    per = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("vec")[i]) for i in range(dims)]).alias("total"), F.sum("norm").alias("norms")
    )
    known = per.agg(F.collect_list(F.struct("cluster", "n", "total", "norms")).alias("clusters"))
    distance = F.transform(
        "clusters",
        lambda c: F.struct(
            (c["cluster"] == F.col("cluster")).alias("own"), c["n"].alias("n"),
            F.greatest(F.lit(0.0), F.col("norm") * c["n"] + c["norms"] - 2 * dot(F.col("vec"), c["total"])).alias("sum"),
        ),
    )
    both = attach_scalars(rows, known).select("id", "cluster", distance.alias("d")).select(
        "id", "cluster",
        F.array_max(F.transform(F.filter("d", lambda x: x["own"] & (x["n"] > 1)), lambda x: x["sum"] / (x["n"] - 1))).alias("inside"),
        F.array_min(F.transform(F.filter("d", lambda x: ~x["own"]), lambda x: x["sum"] / x["n"])).alias("outside"),
    )
    value = F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside"))
    return both.select("id", "cluster", F.coalesce(F.when(F.col("inside").isNull(), 0.0).otherwise(value), F.lit(0.0)).alias("silhouette"))


def _exploded(points: DataFrame, labels: DataFrame) -> DataFrame:
    return points.join(labels, "id").select("id", "cluster", F.posexplode("vec").alias("dim", "x"))


def calinski_harabasz(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: between- over within-cluster dispersion."""
    rows = _exploded(points, labels)
    per = rows.groupBy("cluster", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss"))
    all_ = rows.groupBy("dim").agg(F.avg("x").alias("g"))
    joined = per.join(all_, "dim")
    sums = joined.agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"),
        F.sum("ss").alias("within"),
        F.countDistinct("cluster").alias("k"),
        F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"),
    )
    return sums.select(
        F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("calinski_harabasz")
    )


def davies_bouldin(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean over clusters of the worst spread-to-separation ratio.

    Centroid pairs are cluster pairs (k², k a small constant), joined on dimension.
    """
    rows = stage(_exploded(points, labels), "exploded")
    centre = stage(rows.groupBy("cluster", "dim").agg(F.avg("x").alias("c")), "centres")
    gap = rows.join(centre, ["cluster", "dim"]).groupBy("id", "cluster").agg(
        F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("d")
    )
    spread = gap.groupBy("cluster").agg(F.avg("d").alias("s"))
    other = centre.select(F.col("cluster").alias("other"), "dim", F.col("c").alias("oc"))
    apart = centre.join(other, "dim").where(F.col("cluster") != F.col("other")).groupBy("cluster", "other").agg(
        F.sqrt(F.sum((F.col("c") - F.col("oc")) * (F.col("c") - F.col("oc")))).alias("m")
    )
    ratio = apart.join(spread, "cluster").join(spread.select(F.col("cluster").alias("other"), F.col("s").alias("os")), "other")
    worst = ratio.groupBy("cluster").agg(F.max(F.try_divide(F.col("s") + F.col("os"), F.col("m"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def quality_row(points: DataFrame, labels: DataFrame, method: str, exact: bool = False) -> DataFrame:
    """Three measures of one labelling. ``exact`` takes the Euclidean silhouette, which is quadratic."""
    pts, lab = stage(points, "points"), stage(labels.select("id", "cluster"), "labels")
    s = (silhouette if exact else squared_silhouette)(pts, lab).agg(F.round(F.avg("silhouette"), 4).alias("silhouette"))
    out = attach_scalars(s, calinski_harabasz(pts, lab).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz")))
    out = attach_scalars(out, davies_bouldin(pts, lab).select(F.round("davies_bouldin", 4).alias("davies_bouldin")))
    # one cluster has no separation: the worst value of each measure
    return out.select(
        F.lit(method).alias("method"),
        F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"),
        F.coalesce("calinski_harabasz", F.lit(0.0)).alias("calinski_harabasz"),
        F.coalesce("davies_bouldin", F.lit(float("inf"))).alias("davies_bouldin"),
    )


def compare_methods(points: DataFrame, labelings: Mapping[str, DataFrame]) -> DataFrame:
    """Quality of each method with the best silhouette marked; earlier names win ties."""
    out = None
    for i, (name, labels) in enumerate(labelings.items()):
        row = quality_row(points, labels, name).withColumn("ord", F.lit(i))
        out = row if out is None else out.unionByName(row)
    out = stage(out, "quality")
    best = out.agg(F.min_by("method", F.struct(-F.col("silhouette"), F.col("ord"))).alias("best"))
    return attach_scalars(out, best).select(
        "method", "silhouette", "calinski_harabasz", "davies_bouldin", (F.col("method") == F.col("best")).alias("recommended")
    )


def quality_label(silhouette_value: Column) -> Column:
    v = silhouette_value
    return F.when(v >= 0.7, "Excellent").when(v >= 0.5, "Good").when(v >= 0.25, "Fair").otherwise("Poor")


def scaled_quality(rows: DataFrame) -> DataFrame:
    return rows.select(
        "method",
        "silhouette",
        F.least(F.col("calinski_harabasz") / 1000.0, F.lit(1.0)).alias("ch_scaled"),
        F.greatest(F.lit(0.0), 1.0 - F.col("davies_bouldin") / 2.0).alias("db_inverted"),
    )


# ---- lookups ----


def site_lookup(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Label, risk, size and, for a mixture, the confidence of each site."""
    confidence = F.array_max("probabilities") if "probabilities" in labels.columns else F.lit(None).cast("double")
    probabilities = F.col("probabilities") if "probabilities" in labels.columns else F.lit(None).cast("array<double>")
    rows = labels.select("id", "cluster", confidence.alias("confidence"), probabilities.alias("probabilities"))
    return rows.join(profiles.select("cluster", "size", "risk_level", "description"), "cluster", "left")


def projection(points: DataFrame, labels: DataFrame, dims: int = 3, profiles: DataFrame | None = None) -> DataFrame:
    """Principal components of scaled features with each point's cluster and, given the
    clusters' profiles, its risk level. The largest loading of a component is positive."""
    rows = _vectors(stage(points, "points"))
    model = PCA(k=dims, inputCol="features", outputCol="pc").fit(rows)
    loadings = model.pc.toArray()
    largest = np.abs(loadings).round(9).argmax(axis=0)
    sign = np.sign(loadings[largest, np.arange(loadings.shape[1])])
    xyz = model.transform(rows).select("id", vector_to_array("pc").alias("pc"))
    placed = xyz.join(labels.select("id", "cluster"), "id").select(
        "id", *[(F.col("pc")[i] * float(sign[i])).alias(n) for i, n in enumerate("xyz"[:dims])], F.greatest(F.lit(0), "cluster").alias("cluster")
    )
    return placed if profiles is None else placed.join(profiles.select("cluster", "risk_level"), "cluster", "left")


def sites_per_risk(profiles: DataFrame) -> DataFrame:
    per = profiles.groupBy("risk_level").agg(F.sum("size").alias("sites"))
    total = profiles.agg(F.sum("size").alias("total"))
    return attach_scalars(per, total).select("risk_level", "sites", F.round(F.col("sites") * 100.0 / F.col("total"), 1).alias("percent"))


def members_of(labels: DataFrame, cluster: int) -> DataFrame:
    return labels.where(F.col("cluster") == cluster).select("id")


def peer_clusters(profiles: DataFrame, cluster: int) -> DataFrame:
    return profiles.where(F.col("cluster") != cluster).select("cluster", "size", "risk_level")


# ---- invariants ----


def labelled_once(points: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``id, ok``: every point has exactly one label from 0 to k - 1."""
    per = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("c"))
    ok = (F.col("n") == 1) & F.col("c").between(0, k - 1)
    return points.select("id").join(per, "id", "left").select("id", F.coalesce(ok, F.lit(False)).alias("ok"))


def nearest_to_own_centre(points: DataFrame, labels: DataFrame, slack: float = 1e-3) -> DataFrame:
    """``id, ok``: no other cluster's mean is closer than the mean of the point's own."""
    rows = stage(_exploded(points, labels), "exploded")
    centre = rows.groupBy(F.col("cluster").alias("other"), "dim").agg(F.avg("x").alias("c"))
    gap = rows.join(centre, "dim").groupBy("id", "cluster", "other").agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("d"))
    own = F.max(F.when(F.col("cluster") == F.col("other"), F.col("d")))
    return gap.groupBy("id").agg((own <= F.min("d") + slack).alias("ok"))
