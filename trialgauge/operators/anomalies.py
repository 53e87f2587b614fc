"""Anomaly scores, control charts, drift and their rollups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import fixed
from ..plans.ordering import exact_quantiles, top_per_group, with_running_totals
from ..plans.staging import stage
from .joins import attach_scalars
from .neighbours import local_outlier_factor

Stats = Mapping[str, Mapping[str, float]]

# Share of each method in the ensemble, level floors, features of the older detector,
# trees, their sample, share of anomalies, seed, neighbours, and the least contribution that is named.
ENSEMBLE_WEIGHTS = {"isolation_forest": 0.4, "lof": 0.3, "statistical": 0.2, "mahalanobis": 0.1}
LEVELS = [("Critical", 0.3), ("High", 0.2), ("Medium", 0.1), ("Low", 0.0)]
LEGACY_FEATURES = [
    "missing_visits_pct", "missing_pages_pct", "open_issues_per_subject",
    "safety_pending_pct", "days_outstanding_avg", "days_pages_missing_avg",
]
TREES, SUBSAMPLE, CONTAMINATION, SEED = 200, 256, 0.1, 42
LOF_NEIGHBOURS = 20
CONTRIBUTION_LIMIT = 0.5


def _num(x: float) -> str:
    return f"{float(x)!r}D"


def feature_stats(features: DataFrame, metrics: Sequence[str], key: str = "site_id") -> Stats:
    """Mean and population deviation per metric, as plain numbers (one wide row)."""
    from ..plans.features import steady_deviation

    row = features.agg(
        *[F.avg(m).alias(f"m{i}") for i, m in enumerate(metrics)],
        *[steady_deviation(m, F.stddev_pop(m)).alias(f"s{i}") for i, m in enumerate(metrics)],
    ).first()
    return {m: {"mean": row[f"m{i}"], "std": row[f"s{i}"]} for i, m in enumerate(metrics)}


def population_stats(features: DataFrame, metrics: Sequence[str], key: str = "site_id") -> DataFrame:
    """Mean, population deviation, median, quartiles and extremes per metric."""
    from ..plans.features import steady_deviation, unpivot

    rows = unpivot(features, key, list(metrics)).where(F.col("value").isNotNull())
    moments = rows.groupBy("metric").agg(
        F.avg("value").alias("mean"), steady_deviation("value", F.stddev_pop("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    cuts = exact_quantiles(rows, ["metric"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(cuts, "metric")


def _scaled(metric: str, s: Mapping[str, float]) -> str:
    """Zero mean, unit population deviation; a constant column becomes zero."""
    value = f"coalesce(CAST(`{metric}` AS DOUBLE), 0D)"
    return f"({value} - {_num(s['mean'])}) / {_num(s['std'])}" if s["std"] else "0D"


def scaled_vectors(features: DataFrame, metrics: Sequence[str], stats: Stats, key: str = "site_id") -> DataFrame:
    """``id, vec``."""
    return features.selectExpr(f"`{key}` AS id", f"array({', '.join(_scaled(m, stats[m]) for m in metrics)}) AS vec")


def _abs_z(metric: str, s: Mapping[str, float]) -> str:
    return f"abs((`{metric}` - {_num(s['mean'])}) / {_num(s['std'])})" if s["std"] else "CAST(NULL AS DOUBLE)"


def statistical_score(metrics: Sequence[str], stats: Stats) -> Column:
    """Largest absolute z over three sigma, clipped to one."""
    zs = ", ".join(_abs_z(m, stats[m]) for m in metrics)
    return F.expr(f"least(1D, coalesce(array_max(array({zs})), 0D) / 3D)")


def contributions(metrics: Sequence[str], stats: Stats) -> Column:
    pairs = ", ".join(f"'{m}', least(coalesce({_abs_z(m, stats[m])}, 0D) / 3D, 1D)" for m in metrics)
    return F.expr(f"map({pairs})")


def anomalous_features(contrib: Column, metrics: Sequence[str], limit: float = CONTRIBUTION_LIMIT) -> Column:
    """Names at or above the limit, largest first, ties in metric order."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(metrics) for x in (m, i)])
    entries = F.filter(F.map_entries(contrib), lambda e: e["value"] >= limit)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), order[e["key"]].alias("o"), e["key"].alias("k"))))
    return F.transform(ranked, lambda e: e["k"])


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Min-max to [0, 1] with a tiny floor on the span."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    out = attach_scalars(df, bounds)
    return out.withColumn(column, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-10))).drop("_lo", "_hi")


# ---- isolation forest ----


def _path_constant(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _share(*parts: object) -> float:
    """A number in [0, 1) that follows from its parts, by the first 32 bits of their digest."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _grow_tree(rows: np.ndarray, seed: int, tree: int) -> list[tuple[int, float, int, int, float]]:
    """``(dim, cut, left, right, value)``; leaves have dim -1 and carry their path length.

    Dimension and cut of a node follow from seed, tree and the way to it, so that a tree is the
    same wherever it grows.
    """
    limit = math.ceil(math.log2(max(2, len(rows))))
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(part: np.ndarray, way: str) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, len(way) + _path_constant(len(part))))
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(way) < limit and len(usable):
            dim = int(usable[int(_share(seed, tree, way, "dim") * len(usable))])
            cut = float(lo[dim] + _share(seed, tree, way, "cut") * (hi[dim] - lo[dim]))
            low = part[:, dim] <= cut
            if not low.all():
                nodes[at] = (dim, cut, grow(part[low], way + "l"), grow(part[~low], way + "r"), 0.0)
        return at

    grow(rows, "")
    return nodes


def fit_isolation_forest(
    points: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED
) -> tuple[list[list[tuple]], int]:
    """Trees over subsamples (Liu et al., 2008).

    A tree's sample are the rows with its ``subsample`` smallest digests of seed, tree and id, so
    samples are independent and neither layout nor size of the input changes how they are
    drawn. Ids alone are drawn; their vectors join the few that are left. Trees grow in parallel
    tasks; the model that returns is bounded by ``trees × 2 × subsample`` nodes.
    """
    points = stage(points.select("id", "vec"), "points")
    n = points.count()
    size = min(subsample, n)
    named = points.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    named = named.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("id").cast("string"))))
    few = F.conv(F.substring("draw", 1, 15), 16, 10).cast("double") / float(1 << 60) <= (2.0 * subsample + 64.0) / max(n, 1)
    picked = top_per_group(named.where(few), ["tree"], [F.asc("draw"), F.asc("id")], size).join(points, "id")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow_tree(np.stack(pdf["vec"].to_numpy()), seed, tree)
        return pd.DataFrame(nodes, columns=["dim", "cut", "left", "right", "value"]).assign(tree=tree, at=range(len(nodes)))

    schema = "dim int, cut double, left int, right int, value double, tree int, at int"
    rows = picked.select("tree", "id", "vec").groupBy("tree").applyInPandas(grow, schema).collect()
    model: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["at"])):
        model.setdefault(r["tree"], []).append((r["dim"], r["cut"], r["left"], r["right"], r["value"]))
    return list(model.values()), size


def score_isolation_forest(points: DataFrame, model: tuple[list[list[tuple]], int]) -> DataFrame:
    """``id, raw``: anomaly score in (0, 1), larger is stranger."""
    trees, size = model
    arrays = [tuple(np.array(col) for col in zip(*t)) for t in trees]
    shared = points.sparkSession.sparkContext.broadcast((arrays, _path_constant(size) or 1.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, norm = shared.value
        for pdf in batches:
            x = np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for dim, cut, left, right, value in forest:
                at = np.zeros(len(x), dtype=int)
                while len(x):
                    inner = dim[at] >= 0
                    if not inner.any():
                        break
                    here = at[inner]
                    low = x[inner, dim[here]] <= cut[here]
                    at[inner] = np.where(low, left[here], right[here])
                total += value[at]
            yield pd.DataFrame({"id": pdf["id"], "raw": 2.0 ** (-(total / max(1, len(forest))) / norm)})

    return points.select("id", "vec").mapInPandas(score, "id string, raw double")


FOREST_SCHEMA = "tree int, at int, dim int, cut double, `left` int, `right` int, value double, size int"


def save_isolation_forest(spark, model: tuple[list[list[tuple]], int], path: str) -> None:
    """One row per node; ``size`` is the sample the trees were grown from."""
    trees, size = model
    rows = [(t, at, *map(float_or_int, node), size) for t, nodes in enumerate(trees) for at, node in enumerate(nodes)]
    spark.createDataFrame(rows, FOREST_SCHEMA).write.mode("overwrite").parquet(path)


def float_or_int(x):
    """A node's number without its numpy type."""
    return x.item() if hasattr(x, "item") else x


def load_isolation_forest(spark, path: str) -> tuple[list[list[tuple]], int]:
    """The model is bounded by its trees and their samples, whatever data it was fitted on."""
    rows = spark.read.schema(FOREST_SCHEMA).parquet(path).orderBy("tree", "at").collect()
    trees: dict[int, list[tuple]] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append((r["dim"], r["cut"], r["left"], r["right"], r["value"]))
    return list(trees.values()), rows[0]["size"] if rows else 0


def isolation_scores(points: DataFrame, trees: int = TREES, contamination: float = CONTAMINATION) -> DataFrame:
    """``id, score``: positive for the ``contamination`` share of strangest points."""
    raw = stage(score_isolation_forest(points, fit_isolation_forest(points, trees)), "forest")
    cut = exact_quantiles(raw, [], "raw", {"offset": 1.0 - contamination})
    return attach_scalars(raw, cut).select("id", (F.col("raw") - F.col("offset")).alias("score"))


def legacy_level(score: Column) -> Column:
    return F.when(score > 0.2, "Critical").when(score > 0.1, "High").when(score > 0.0, "Medium").otherwise("Low")


# ---- robust Mahalanobis ----


def _gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    for _ in range(5000):
        k += 1.0
        term *= x / k
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_cdf(x: float, dof: float) -> float:
    return _gamma_cdf(dof / 2.0, x / 2.0)


def chi2_quantile(p: float, dof: float) -> float:
    lo, hi = 0.0, dof + 40.0 * math.sqrt(dof) + 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2.0


def _moments(points: DataFrame, dims: int, where: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance of a subset in one aggregate of d(d+3)/2 numbers."""
    rows = points if where is None else points.where(where)
    v = lambda i: F.col("vec")[i]
    aggs = [F.avg(v(i)).alias(f"m{i}") for i in range(dims)]
    aggs += [F.covar_pop(v(i), v(j)).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]
    row = rows.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    mean = np.array([row[f"m{i}"] for i in range(dims)], dtype=float)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return mean, cov, row["n"]


def _distance_sql(mean: np.ndarray, inverse: np.ndarray) -> str:
    """Squared Mahalanobis distance of ``vec`` as one SQL expression."""
    diffs = [f"(vec[{i}] - {_num(m)})" for i, m in enumerate(mean)]
    terms = []
    for i in range(len(mean)):
        for j in range(i, len(mean)):
            c = inverse[i, j] * (1.0 if i == j else 2.0)
            if c != 0.0:
                terms.append(f"{_num(c)} * {diffs[i]} * {diffs[j]}")
    return " + ".join(terms) or "0D"


def robust_distances(points: DataFrame, dims: int, steps: int = 100) -> DataFrame:
    """``id, distance`` to the fit of the same points."""
    pts = stage(points, "points")
    return distances_to(pts, fit_robust(pts, dims, steps))


#: Live coordinates, their mean, and the inverse covariance.
RobustFit = tuple[list[int], np.ndarray, np.ndarray]


def distances_to(points: DataFrame, fit: RobustFit) -> DataFrame:
    """``id, distance``: squared distance of each point under a fit, its own or a loaded one."""
    live, mean, inverse = fit
    if not live:
        return points.select("id", F.lit(0.0).alias("distance"))
    rows = points.select("id", F.array(*[F.col("vec")[i] for i in live]).alias("vec"))
    return rows.select("id", F.expr(_distance_sql(mean, inverse)).alias("distance"))


def save_robust_fit(spark, fit: RobustFit, path: str) -> None:
    live, mean, inverse = fit
    rows = [(i, dim, float(mean[i]), [float(x) for x in inverse[i]]) for i, dim in enumerate(live)]
    spark.createDataFrame(rows, "at int, dim int, mean double, inverse array<double>").write.mode("overwrite").parquet(path)


def load_robust_fit(spark, path: str) -> RobustFit:
    rows = spark.read.parquet(path).orderBy("at").collect()  # a row per coordinate
    return [r["dim"] for r in rows], np.array([r["mean"] for r in rows]), np.array([r["inverse"] for r in rows])


#: Starts of the robust fit, rows of the sample they run on, and starts that go on with all rows.
STARTS, START_ROWS, FINALISTS = 50, 1500, 2


def _concentrate(x: np.ndarray, own: np.ndarray, h: int, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log determinant, mean and covariance after concentration steps on a sample, from the rows ``own``."""
    d, last = x.shape[1], math.inf
    mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True).reshape(d, d)
    for _ in range(steps):
        centred = x - mean
        distance = np.einsum("ni,ij,nj->n", centred, np.linalg.pinv(cov), centred)
        own = np.argsort(distance, kind="stable")[:h]
        mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True).reshape(d, d)
        det = float(np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1])
        if not det < last - 1e-9:
            break
        last = det
    return last, mean, cov


def _starts(points: DataFrame, n: int, d: int, steps: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the best starts on a sample, every start in a task of its own.

    The sample are the rows with the smallest digests, ``START_ROWS`` at most; a start draws
    d + 1 of them, but the first start is all of them.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    few = F.conv(F.substring(draw, 1, 15), 16, 10).cast("double") / float(1 << 60) <= (2.0 * START_ROWS + 64.0) / max(n, 1)
    sample = points.where(few).select("id", "vec", draw.alias("draw")).orderBy("draw", "id").limit(START_ROWS)
    each = sample.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "id"], kind="stable")
        x, start = np.stack(pdf["vec"].to_numpy()), int(pdf["start"].iloc[0])
        own = np.arange(len(x)) if start == 0 else np.argsort([_share(seed, start, i) for i in range(len(x))], kind="stable")[: d + 1]
        h = min(len(x), (len(x) + d + 1) // 2)
        det, mean, cov = _concentrate(x, own, h, steps)
        return pd.DataFrame({"start": [start], "det": [det], "mean": [mean.tolist()], "cov": [cov.ravel().tolist()]})

    found = each.groupBy("start").applyInPandas(run, "start int, det double, mean array<double>, cov array<double>")
    best = sorted(found.collect(), key=lambda r: (round(r["det"], 6), r["start"]))
    picked, seen = [], set()
    for r in best:
        if (key := round(r["det"], 6)) not in seen:
            seen.add(key)
            picked.append((np.array(r["mean"]), np.array(r["cov"]).reshape(d, d)))
    return picked[:FINALISTS]


#: Low bits of a distance that the first look of a step leaves open, and bits that each further look settles.
OPEN_BITS, LOOK_BITS = 45, 12


def _tally(dims: int, mean: np.ndarray, inverse: np.ndarray, lowest: int, highest: int, bits: int):
    """Count, extremes and centred sums of the rows of a partition by the leading bits of their distance from ``lowest`` to ``highest``."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[pd.DataFrame] = []
        for pdf in batches:
            x = [pdf[f"x{i}"].to_numpy() - mean[i] for i in range(dims)]
            # term by term, so that equal rows are equally far wherever they lie
            distance = np.zeros(len(pdf))
            for i, j in pairs:
                distance += (inverse[i, j] * (1.0 if i == j else 2.0)) * x[i] * x[j]
            distance = np.maximum(distance, 0.0)  # the bits of such numbers stand in their order
            place = distance.view(np.int64)
            inside = (place >= lowest) & (place <= highest)
            sums = {f"s{i}": x[i] for i in range(dims)} | {f"c{i}_{j}": x[i] * x[j] for i, j in pairs}
            table = pd.DataFrame({"key": place >> bits, "n": 1, "low": place, "high": place, **sums})[inside]
            found.append(table)
            if len(found) > 1:
                found = [pd.concat(found)]
            ways = {c: "min" if c == "low" else "max" if c == "high" else "sum" for c in table.columns if c != "key"}
            found = [found[0].groupby("key", as_index=False).agg(ways)]
        yield from found

    return tally


def _nearest_moments(points: DataFrame, dims: int, h: int, mean: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the ``h`` rows of ``points(x0, …)`` nearest to a fit, with all that are as far as the last one.

    Rows are summed by the leading bits of their distance. Groups below the ``h``-th row are taken whole; that
    row's own group is looked at again by its next bits until its rows are equally far, or all of it is taken.
    The groups of a look are bounded by the bits, not by the rows.
    """
    names = [f"s{i}" for i in range(dims)] + [f"c{i}_{j}" for i in range(dims) for j in range(i, dims)]
    schema = "key long, n long, low long, high long, " + ", ".join(f"{c} double" for c in names)
    taken, total = 0, np.zeros(len(names))
    lowest, highest, bits = 0, (1 << 63) - 1, OPEN_BITS
    while True:
        parts = points.mapInPandas(_tally(dims, mean, inverse, lowest, highest, bits), schema)
        groups = parts.groupBy("key").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in names]
        )
        for group in sorted(groups.collect(), key=lambda r: r["key"]):
            last = taken + group["n"] >= h
            if last and taken + group["n"] > h and group["low"] < group["high"]:
                lowest, highest, bits = group["low"], group["high"], max(0, bits - LOOK_BITS)
                break
            taken, total = taken + group["n"], total + np.array([group[c] for c in names])
            if last:
                return _from_sums(dims, taken, total, mean)


def _from_sums(dims: int, n: int, total: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums around ``centre``; what is left of a constant coordinate by rounding is zero."""
    moved = total[:dims] / n
    square = np.zeros((dims, dims))
    square[np.triu_indices(dims)] = total[dims:] / n
    square = np.triu(square) + np.triu(square, 1).T
    cov = square - np.outer(moved, moved)
    size = np.sqrt(np.diag(square))
    return centre + moved, np.where(np.abs(cov) <= 1e-13 * np.outer(size, size), 0.0, cov)


def fit_robust(points: DataFrame, dims: int, steps: int = 100, seed: int = SEED) -> RobustFit:
    """Minimum covariance determinant.

    Concentration steps (Rousseeuw & Van Driessen, 1999): many starts run side by side on a bounded
    sample, and the best of them go on with all rows. There a step is an aggregate, or a few of
    them; an 8×8 inverse is all the driver computes. The fit is made consistent by the
    chi-square median and reweighted at its 97.5 % point. Steps that have not settled after
    ``steps`` are an error.
    """
    pts = stage(points, "points")
    n = pts.count()
    mean, cov, _ = _moments(pts, dims)
    live = [i for i in range(dims) if cov[i, i] > 1e-12]
    if not live:
        return [], np.zeros(0), np.zeros((0, 0))
    pts = stage(pts.select("id", F.array(*[F.col("vec")[i] for i in live]).alias("vec")), "points")
    d = len(live)
    h = min(n, (n + d + 1) // 2)
    plain = stage(pts.select(*[F.col("vec")[i].alias(f"x{i}") for i in range(d)]), "coordinates")
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for mean, cov in _starts(pts, n, d, steps, seed):
        last = math.inf
        for _ in range(steps):
            mean, cov = _nearest_moments(plain, d, h, mean, np.linalg.pinv(cov))
            det = float(np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1])
            if not det < last - 1e-7:
                break
            last = det
        else:
            raise RuntimeError(f"concentration did not settle in {steps} steps")
        if best is None or det < best[0]:
            best = (det, mean, cov)
    _, mean, cov = best
    scored = pts.withColumn("distance", F.expr(_distance_sql(mean, np.linalg.pinv(cov))))
    median = exact_quantiles(scored, [], "distance", {"q": 0.5}).first()["q"]
    cov = cov * max(median / chi2_quantile(0.5, d), 1e-12)
    scored = pts.withColumn("distance", F.expr(_distance_sql(mean, np.linalg.pinv(cov))))
    mean, cov, _ = _moments(scored, d, F.col("distance") <= chi2_quantile(0.975, d))
    return live, mean, np.linalg.pinv(cov)


# ---- ensemble ----


def risk_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, floor in LEVELS[1:-1]:
        out = out.when(score >= floor, name)
    return out.otherwise("Low")


def combine(scores: DataFrame, method: str = "ensemble") -> Column:
    """Weighted sum over the four methods (absent ones count zero); the weights always
    divide by their full sum. A single method is its own score, an unknown one the forest's."""
    if method != "ensemble":
        return F.col(method if method in scores.columns else "isolation_forest")
    total = F.lit(0.0)
    for name, w in ENSEMBLE_WEIGHTS.items():
        if name in scores.columns:
            total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
    return total / sum(ENSEMBLE_WEIGHTS.values())


def explanation(metrics: Sequence[str]) -> Column:
    """Sentence over ``site_id, risk_level, anomalous, `` and the metric columns."""
    def shown(m: str) -> Column:
        label = m.replace("_", " ")
        v = F.col(m)
        return F.concat(F.lit(f"{label}: "), fixed(v * 100, 1), F.lit("%")) if "_pct" in m else F.concat(F.lit(f"{label}: "), fixed(v, 2))

    text = F.create_map(*[x for m in metrics for x in (F.lit(m), shown(m))])
    listed = F.concat_ws(", ", F.transform(F.slice("anomalous", 1, 3), lambda f: text[f]))
    # fixed values: the sentences
    return F.when(
        F.size("anomalous") == 0, F.concat(F.lit("Site "), F.col("site_id"), F.lit(" shows normal behavior across all metrics."))
    ).otherwise(
        F.concat(F.lit("Site "), F.col("site_id"), F.lit(" is "), F.col("risk_level"), F.lit(" risk due to anomalous values in: "), listed)
    )


def describe(features: DataFrame, scores: DataFrame, metrics: Sequence[str], stats: Stats, method: str = "ensemble") -> DataFrame:
    """Full anomaly rows. ``scores(id, <method>…)``; the z-score method is computed here."""
    base = features.withColumns({"statistical": statistical_score(metrics, stats), "contributions": contributions(metrics, stats)})
    joined = base.join(scores.withColumnRenamed("id", "site_id"), "site_id")
    scored = joined.withColumn("anomaly_score", combine(joined, method))
    scored = scored.withColumns(
        {
            "is_anomaly": F.col("anomaly_score") > 0.0,
            "risk_level": risk_level(F.col("anomaly_score")),
            "anomalous": anomalous_features(F.col("contributions"), metrics),
        }
    )
    return scored.withColumn("explanation", explanation(metrics))


def detect(features: DataFrame, metrics: Sequence[str], method: str = "ensemble", trees: int = TREES, key: str = "site_id") -> DataFrame:
    """Run all four methods over every site and combine them."""
    features = stage(features, "features")
    stats = feature_stats(features, metrics, key)
    points = stage(scaled_vectors(features, metrics, stats, key), "points")
    n = points.count()
    forest = normalised(stage(isolation_scores(points, trees), "scores"), "score").select("id", F.col("score").alias("isolation_forest"))
    lof = normalised(stage(local_outlier_factor(points, min(LOF_NEIGHBOURS, n - 1)), "scores"), "lof").select("id", "lof")
    robust = normalised(stage(robust_distances(points, len(metrics)), "scores"), "distance")
    scores = forest.join(lof, "id").join(robust.select("id", F.col("distance").alias("mahalanobis")), "id")
    return stage(describe(features, scores, metrics, stats, method), "anomalies")


# ---- control charts ----


def control_charts(features: DataFrame, metrics: Sequence[str], stats: Stats, key: str = "site_id") -> DataFrame:
    """Two- and three-sigma limits of every metric for every site."""
    rows = []
    for m in metrics:
        mean, std = stats[m]["mean"], stats[m]["std"]
        ucl, lcl, usl, lsl = mean + 2 * std, max(0.0, mean - 2 * std), mean + 3 * std, max(0.0, mean - 3 * std)
        v = f"CAST(`{m}` AS DOUBLE)"
        kind = (
            f"CASE WHEN {v} > {_num(usl)} THEN 'above_usl' WHEN {v} > {_num(ucl)} THEN 'above_ucl' "
            f"WHEN {v} < {_num(lsl)} THEN 'below_lsl' WHEN {v} < {_num(lcl)} THEN 'below_lcl' END"
        )
        rows.append(
            f"struct('{m}' AS metric, {v} AS value, {_num(mean)} AS mean, {_num(std)} AS std, {_num(ucl)} AS ucl, {_num(lcl)} AS lcl, "
            f"{_num(usl)} AS usl, {_num(lsl)} AS lsl, {kind} AS violation)"
        )
    charts = features.selectExpr(f"`{key}`", f"inline_outer(array({', '.join(rows)}))")
    return charts.withColumn("out_of_control", F.col("violation").isNotNull())


# ---- drift ----


def kolmogorov_tail(lam: str, terms: int = 100) -> Column:
    """P(K > lam) from the alternating series; one where the series has not yet fallen."""
    series = (
        f"aggregate(sequence(1, {terms}), 0D, (acc, k) -> acc + CASE WHEN k % 2 = 1 THEN 2D ELSE -2D END "
        f"* exp(-2D * k * k * {lam} * {lam}))"
    )
    return F.expr(f"CASE WHEN {lam} < 0.2D THEN 1D ELSE greatest(0D, least(1D, {series})) END")


MIN_DRIFT_VALUES = 5


#: Sizes of both samples up to which the law of the statistic is exact.
EXACT_SIZE = 10_000


def exact_tail(steps: int, m: int, n: int) -> float:
    """P(the largest gap of two samples of sizes m and n is ``steps / (m n)`` or more), for samples of one continuous law.

    All orders of the pooled sample are alike, so they are lattice paths from (0, 0) to (m, n). The
    chance that the path to a point has left the band is found diagonal by diagonal from
    the chances of the two points before it; it is summed directly, so small tails keep their digits.
    """
    i = np.arange(m + 1)
    left = np.zeros(m + 1)
    left[0] = steps <= 0
    for k in range(1, m + n + 1):
        low, high = max(0, k - n), min(k, m)
        own = i[low : high + 1]
        now = left[low : high + 1] * ((k - own) / k)
        now[(1 if low == 0 else 0) :] += left[max(low - 1, 0) : high] * (own[(1 if low == 0 else 0) :] / k)
        now[np.abs(own * n - (k - own) * m) >= steps] = 1.0
        left[low : high + 1] = now
    return float(left[m])


def _exact_tails(steps: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([exact_tail(int(s), int(a), int(b)) for s, a, b in zip(steps, m, n, strict=True)], dtype=float)


def ks_two_sample(rows: DataFrame, exact_size: int = EXACT_SIZE) -> DataFrame:
    """Kolmogorov–Smirnov statistic per feature over ``rows(feature, side, value)``.

    ``side`` is 'reference' or 'current'. Values collapse to counts per side before the
    running totals, so repeated values cost one row. The p-value is exact while both sides have
    ``exact_size`` values at most, and follows the asymptotic law beyond.
    """
    ref = F.sum(F.when(F.col("side") == "reference", 1).otherwise(0)).alias("ref")
    cur = F.sum(F.when(F.col("side") == "current", 1).otherwise(0)).alias("cur")
    counts = stage(rows.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(ref, cur), "drift")
    cum = with_running_totals(counts, [F.asc("value")], ["ref", "cur"], ["feature"])
    enough = cum.where((F.col("all_ref") >= MIN_DRIFT_VALUES) & (F.col("all_cur") >= MIN_DRIFT_VALUES))
    gap = F.abs(F.col("cum_ref") / F.col("all_ref") - F.col("cum_cur") / F.col("all_cur"))
    out = enough.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.first("all_ref").alias("n_reference"), F.first("all_cur").alias("n_current")
    )
    out = stage(out, "statistics")
    m, n = F.col("n_reference"), F.col("n_current")
    lam = F.sqrt(m * n / (m + n)) * F.col("statistic")
    few = F.greatest(m, n) <= exact_size
    exact = F.pandas_udf(_exact_tails, "double")
    law = out.where(~few).withColumn("lam", lam).withColumn("p_value", kolmogorov_tail("lam")).drop("lam")
    # one row per feature; the statistic is a whole number of steps of 1 / (m n)
    steps = F.round(F.col("statistic") * m * n).cast("long")
    return law.unionByName(out.where(few).withColumn("p_value", exact(steps, m, n)))


def drift_verdict(tests: DataFrame, features_seen: int, alpha: float = 0.05) -> DataFrame:
    """One row: whether, how strongly and in what way the distributions moved."""
    drifted = F.count_if(F.col("p_value") < alpha)
    row = tests.agg(
        drifted.alias("drifted"),
        F.coalesce(F.avg("statistic"), F.lit(0.0)).alias("drift_score"),
        F.coalesce(F.min("p_value"), F.lit(1.0)).alias("p_value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "p_value")))).alias("feature_p_values"),
    )
    kind = F.when(F.col("drifted") == 0, F.lit(None)).when(
        F.col("drifted") > 0.5 * features_seen, "concept_drift"
    ).when(F.col("drift_score") > 0.3, "sudden_drift").otherwise("gradual_drift")
    return row.select(
        (F.col("drifted") > 0).alias("drift_detected"), kind.cast("string").alias("drift_type"), "drift_score", "p_value", "drifted", "feature_p_values"
    )


# ---- rollups ----


def at_or_above(found: DataFrame, level: str = "Medium") -> DataFrame:
    names = [n for n, _ in LEVELS]
    return found.where(F.col("risk_level").isin(names[: names.index(level) + 1]))


def level_top(found: DataFrame, level: str, limit: int) -> DataFrame:
    return found.where(F.col("risk_level") == level).orderBy(F.desc("anomaly_score"), "site_id").limit(limit)


def level_table(spark) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, (n, _) in enumerate(LEVELS)], "risk_level string, level_ord int")


def risk_distribution(found: DataFrame) -> DataFrame:
    """Count and percent per level; empty levels stay."""
    counts = found.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = attach_scalars(level_table(found.sparkSession).join(counts, "risk_level", "left"), total)
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select(
        "risk_level", n.alias("n"), F.when(F.col("total") > 0, F.round(n * 100.0 / F.col("total"), 1)).otherwise(0.0).alias("percent")
    )


def feature_frequency(found: DataFrame, limit: int = 6) -> DataFrame:
    """Most frequent anomalous features, as share of sites and relative to the top one."""
    counts = found.select(F.explode_outer("anomalous").alias("feature")).where(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = found.agg(F.count(F.lit(1)).alias("total"))
    most = counts.agg(F.max("n").alias("most"))
    rows = attach_scalars(attach_scalars(counts, totals), most)
    return (
        rows.select(
            "feature", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"),
            F.least(F.lit(100.0), F.col("n") * 100.0 / F.col("most")).alias("bar"),
        )
        .orderBy(F.desc("n"), "feature")
        .limit(limit)
    )


def summary(found: DataFrame) -> DataFrame:
    """Totals, rate, counts per level, five top features and sites, in one row."""
    level = lambda n: F.count_if(F.col("risk_level") == n)
    totals = found.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        *[level(n).alias(n.lower()) for n, _ in LEVELS],
    ).withColumn("anomaly_rate", F.try_divide(F.col("anomaly_count").cast("double"), F.col("total_sites").cast("double")))
    features = feature_frequency(found, 5).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "feature"))), lambda x: x["feature"]).alias("top_features")
    )
    sites = found.orderBy(F.desc("anomaly_score"), "site_id").limit(5).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("anomaly_score")).alias("s"), "site_id"))), lambda x: x["site_id"]
        ).alias("top_sites")
    )
    return attach_scalars(attach_scalars(totals, features), sites)


def peers_at_level(found: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest scores at each site's own level, itself left out.

    The ``k + 1`` best of a level are enough for everyone in it, so each site meets at
    most that many rows.
    """
    best = top_per_group(found.select("risk_level", "site_id", "anomaly_score"), ["risk_level"], [F.desc("anomaly_score"), F.asc("site_id")], k + 1)
    best = best.select("risk_level", F.col("site_id").alias("peer"), F.col("anomaly_score").alias("peer_score"))
    # at most four levels times k + 1 rows
    pairs = found.select("site_id", "risk_level").join(F.broadcast(best), "risk_level").where(F.col("site_id") != F.col("peer"))
    return top_per_group(pairs, ["site_id"], [F.desc("peer_score"), F.asc("peer")], k).select("site_id", "peer", "peer_score", "rank")


# Advice by feature-name fragment, first match wins.
FEATURE_ADVICE = [
    ("missing_visits", "Schedule site visit to address missing visit data"),
    ("missing_pages", "Review CRF completion process with site staff"),
    ("open_issues", "Prioritize query resolution through targeted follow-up"),
    ("safety", "URGENT: Expedite pending safety reviews"),
    ("days", "Address aged data issues through site engagement"),
]


def recommendations(anomalous: Column) -> Column:
    def advice(f: Column) -> Column:
        out = F.when(f.contains(FEATURE_ADVICE[0][0]), FEATURE_ADVICE[0][1])
        for part, text in FEATURE_ADVICE[1:]:
            out = out.when(f.contains(part), text)
        return out

    found = F.filter(F.transform(F.slice(anomalous, 1, 3), advice), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Continue routine monitoring")))


def severity_label(contribution: Column) -> Column:
    return F.when(contribution >= 0.7, "critical").when(contribution >= 0.5, "high").when(contribution >= 0.3, "medium").otherwise("low")


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 0.5, "Severe").when(score >= 0.3, "High").when(score >= 0.2, "Elevated").when(score >= 0.1, "Moderate").otherwise("Normal")
    )


def feature_level_table(found: DataFrame) -> DataFrame:
    """Anomalous feature by risk level."""
    rows = found.select("risk_level", F.explode_outer("anomalous").alias("feature")).where(F.col("feature").isNotNull())
    return rows.groupBy("feature").pivot("risk_level", [n for n, _ in LEVELS]).agg(F.count(F.lit(1))).na.fill(0)
