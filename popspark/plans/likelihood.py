"""Composite likelihood of windowed diversity under pi = pi0 * exp(-mu * sum over t, feature of W a).

Tables: ``slopes`` (chrom, bin, ti, feature, a), ``windows`` (chrom, bin, n_same, n_diff) and ``theta``
(theta_id, pi0, mu, ti, feature, weight), the weights of a feature summing to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.functions import scalars as S
from popspark.operators import scans
from popspark.operators.genmap import chrom_key
from popspark.operators.resample import unit_random


def predict(slopes: DataFrame, theta: DataFrame) -> DataFrame:
    """(theta_id, chrom, bin, b, pi): the few parameter rows are broadcast, sums are partial."""
    x = slopes.join(F.broadcast(theta), ["ti", "feature"])
    s = x.groupBy("theta_id", "pi0", "mu", "chrom", "bin").agg(F.sum(F.col("weight") * F.col("a")).alias("x"))
    b = F.exp(-F.col("mu") * F.col("x"))
    return s.select("theta_id", "chrom", "bin", b.alias("b"), (F.col("pi0") * b).alias("pi"))


def predict_on_grid(binned: DataFrame, theta: DataFrame, w: list[float]) -> DataFrame:
    """The same with log B interpolated over the mutation grid at mu * weight: 0 below it, the last value above."""
    ws = F.array(*[F.lit(float(v)) for v in w])
    last = W.partitionBy("chrom", "bin", "ti", "feature").orderBy("wi")
    k = binned.select("chrom", "bin", "ti", "feature", "wi", ws[F.col("wi")].alias("w0"), F.col("log_b").alias("y0"), F.lead(ws[F.col("wi")]).over(last).alias("w1"), F.lead("log_b").over(last).alias("y1"))
    x = k.join(F.broadcast(theta.withColumn("muw", F.col("mu") * F.col("weight"))), ["ti", "feature"])
    inside = (F.col("muw") >= F.col("w0")) & (F.col("muw") < F.coalesce("w1", F.lit(float("inf"))))
    line = F.when(F.col("w1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("muw") - F.col("w0")) / (F.col("w1") - F.col("w0")) * (F.col("y1") - F.col("y0")))
    s = x.groupBy("theta_id", "pi0", "chrom", "bin").agg(F.sum(F.when(inside, line).otherwise(0.0)).alias("x"))
    return s.select("theta_id", "chrom", "bin", F.exp("x").alias("b"), (F.col("pi0") * F.exp("x")).alias("pi"))


def _nll(pi) -> F.Column:
    return -(F.col("n_diff") * F.log(pi) + F.col("n_same") * F.log1p(-pi))


def negative_log_likelihood(predicted: DataFrame, windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """nll by ``by`` (theta_id by default)."""
    j = predicted.join(windows.select("chrom", "bin", "n_same", "n_diff"), ["chrom", "bin"])
    return j.groupBy(*(by or ["theta_id"])).agg(F.sum(_nll(F.col("pi"))).alias("nll"))


def best(likelihoods: DataFrame) -> DataFrame:
    return likelihoods.orderBy("nll", "theta_id").limit(1)


def profile(slopes: DataFrame, windows: DataFrame, theta: DataFrame, weights: dict[tuple[int, str], list[float]] | None = None, rescale: bool = False, **values: list[float]) -> DataFrame:
    """nll over all combinations of ``values`` of pi0 and mu and of ``weights`` by (ti, feature), every other parameter as in the one set ``theta``.

    Other weights of a feature stay; with ``rescale`` they make up 1 with the given ones, in the proportions they have.
    """
    weights = weights or {}
    mesh = theta.drop("theta_id", *values)
    for name, v in values.items():
        mesh = mesh.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in v])))
    names = [f"w_{t}_{f}" for t, f in weights]
    for name, v in zip(names, weights.values()):
        mesh = mesh.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in v])))
    mesh = mesh.withColumn("theta_id", F.to_json(F.struct("pi0", "mu", *[f"`{n}`" for n in names])))
    given = F.lit(None).cast("double")
    for name, (t, f) in zip(names, weights):
        given = F.when((F.col("ti") == t) & (F.col("feature") == f), F.col(f"`{name}`")).otherwise(given)
    mesh = mesh.withColumn("__given", given)
    if rescale:
        per = W.partitionBy("theta_id", "feature")
        fixed, free = F.sum("__given").over(per), F.sum(F.when(F.col("__given").isNull(), F.col("weight"))).over(per)
        other = F.when(fixed.isNull(), F.col("weight")).otherwise(F.col("weight") * (1 - fixed) / F.nullif(free, F.lit(0.0)))
        mesh = mesh.withColumn("__other", other)
    else:
        mesh = mesh.withColumn("__other", F.col("weight"))
    mesh = mesh.withColumn("weight", F.coalesce("__given", "__other")).drop("__given", "__other")
    got = negative_log_likelihood(predict(slopes, mesh), windows)
    axes = mesh.select("theta_id", "pi0", "mu", *[f"`{n}`" for n in names]).distinct()
    return got.join(F.broadcast(axes), "theta_id").select("pi0", "mu", *[f"`{n}`" for n in names], "nll")


def residuals(predicted: DataFrame, windows: DataFrame) -> DataFrame:
    """Observed less predicted pi and its z score in the chromosome."""
    j = predicted.join(windows.select("chrom", "bin", F.col("pi").alias("observed")), ["chrom", "bin"]).filter("observed IS NOT NULL")
    r = j.withColumn("resid", F.col("observed") - F.col("pi"))
    per = r.groupBy("theta_id", "chrom").agg(F.avg("resid").alias("__m"), F.stddev_pop("resid").alias("__s"))
    return r.join(per, ["theta_id", "chrom"]).withColumn("z", (F.col("resid") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def residuals_in_space(predicted: DataFrame, windows: DataFrame) -> DataFrame:
    """(theta_id, chrom, bin, midpoint, z) for every window along its chromosome; windows without data have a null z."""
    r = residuals(predicted, windows).select("theta_id", "chrom", "bin", "z")
    every = windows.select("chrom", "bin", ((F.col("start") + F.col("end")) / 2).alias("midpoint")).crossJoin(F.broadcast(predicted.select("theta_id").distinct()))
    return every.join(r, ["theta_id", "chrom", "bin"], "left").select("theta_id", "chrom", "bin", "midpoint", "z")


def likelihood_ratio(predicted: DataFrame, windows: DataFrame) -> DataFrame:
    """nll of each theta, nll of one constant pi, and twice their difference."""
    total = windows.agg(F.sum("n_diff").alias("d"), F.sum("n_same").alias("s"))
    p = S.pi(F.col("s"), F.col("d"))
    null = total.select((-(F.col("d") * F.log(p) + F.col("s") * F.log1p(-p))).alias("nll_constant"))
    full = negative_log_likelihood(predicted, windows)
    return full.crossJoin(F.broadcast(null)).withColumn("ratio", 2 * (F.col("nll_constant") - F.col("nll")))


def average_selection(theta: DataFrame, t: list[float]) -> DataFrame:
    """Mean t of each theta and feature: the sum of t * weight, weights summing to 1."""
    ts = F.array(*[F.lit(float(x)) for x in t])
    return theta.groupBy("theta_id", "feature").agg(F.sum(ts[F.col("ti")] * F.col("weight")).alias("mean_t"))


def parametric_bootstrap(theta: DataFrame, errors: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Normal draws of the weights (theta_id, ti, feature, se), clipped at 0 and renormalised by feature."""
    r = theta.join(errors, ["theta_id", "ti", "feature"]).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = [unit_random(seed + k, "theta_id", "ti", "feature", "replicate") for k in (0, 1)]
    normal = F.sqrt(-2 * F.log(1 - u[0])) * F.cos(2 * np.pi * u[1])
    r = r.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") + F.col("se") * normal))
    total = F.sum("weight").over(W.partitionBy("theta_id", "feature", "replicate"))
    return r.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0)).drop("se")


# -- fitting ------------------------------------------------------------------------------------------------------


def least_quadratic(g: np.ndarray, h: np.ndarray, theta: np.ndarray, equal: np.ndarray, value: np.ndarray, side: np.ndarray, most: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Least points z of g (z - theta) + (z - theta) h (z - theta) / 2 where equal z = value and side z <= most, a row for each problem.

    An interior-point method with coordinates scaled to a unit Hessian diagonal; it ends when all are within ``gap``.
    """
    k, n = g.shape
    diagonal = np.einsum("kii->ki", h)
    scale = 1 / np.sqrt(np.maximum(diagonal, 1e-8 * diagonal[:, 1:].max(axis=1, keepdims=True) + 1e-300))
    scale[:, 0] = 1 / np.sqrt(np.maximum(diagonal[:, 0], 1e-300))
    q = h * scale[:, :, None] * scale[:, None, :] + 1e-12 * np.eye(n)
    c = scale * (g - np.einsum("kij,kj->ki", h, theta))
    # rows of the conditions are scaled to length 1
    a, s = equal[None] * scale[:, None, :], side[None] * scale[:, None, :]
    la, ls = np.linalg.norm(a, axis=2, keepdims=True), np.linalg.norm(s, axis=2, keepdims=True)
    a, b, s, m = a / la, value / la[..., 0], s / ls, most / ls[..., 0]
    y = theta / scale
    slack = np.maximum(m - np.einsum("kij,kj->ki", s, y), 1e-3)
    lam, nu = np.ones_like(slack) * np.maximum(1, np.abs(c).max(axis=1, keepdims=True)), np.zeros((k, a.shape[1]))
    zero = np.zeros((k, a.shape[1], a.shape[1])) - 1e-14 * np.eye(a.shape[1])

    def longest(v: np.ndarray, dv: np.ndarray) -> np.ndarray:
        return np.minimum(1, np.where(dv < 0, -v / np.where(dv < 0, dv, -1), np.inf).min(axis=1, keepdims=True))

    for _ in range(100):
        dual = np.einsum("kij,kj->ki", q, y) + c + np.einsum("kji,kj->ki", a, nu) + np.einsum("kji,kj->ki", s, lam)
        off, over = np.einsum("kij,kj->ki", a, y) - b, np.einsum("kij,kj->ki", s, y) + slack - m
        product = (slack * lam).sum(axis=1)
        if np.all((product <= gap) & (np.abs(dual).max(axis=1) <= 1e-9 * (1 + np.abs(c).max(axis=1))) & (np.abs(over).max(axis=1) <= 1e-9 * (1 + np.abs(m).max(axis=1)))):
            break
        kkt = np.block([[q + np.einsum("kri,kr,krj->kij", s, lam / slack, s), a.transpose(0, 2, 1)], [a, zero]])
        inverse = np.linalg.inv(kkt)

        def solve(target, inverse=inverse, dual=dual, off=off, over=over):
            right = np.concatenate([-dual - np.einsum("kji,kj->ki", s, (lam * over - target) / slack), -off], axis=1)
            d = np.einsum("kij,kj->ki", inverse, right)
            ds = -over - np.einsum("kij,kj->ki", s, d[:, :n])
            return d[:, :n], d[:, n:], ds, -(target + lam * ds) / slack

        _, _, ds, dl = solve(slack * lam)
        t = np.minimum(longest(slack, ds), longest(lam, dl))
        mean = product[:, None] / slack.shape[1]
        centre = (((slack + t * ds) * (lam + t * dl)).mean(axis=1, keepdims=True) / mean) ** 3
        dy, dn, ds, dl = solve(slack * lam + ds * dl - centre * mean)
        t = 0.995 * np.minimum(longest(slack, ds), longest(lam, dl))
        t = np.where((product <= gap)[:, None], np.minimum(t, 0.9), t)
        y, nu, slack, lam = y + t * dy, nu + t * dn, np.maximum(slack + t * ds, 1e-200), np.maximum(lam + t * dl, 1e-200)
    return y * scale


class Coordinates:
    """What the coordinates of parameter sets mean: (log pi0, mu * weight of each cell), and the convex set of those allowed."""

    def __init__(self, cells: list[tuple], mu: float | None, pi0_bounds, mu_bounds):
        self.cells, self.features = cells, sorted({f for _, f in cells})
        self.of = np.array([self.features.index(f) for _, f in cells])
        self.fixed_mu, self.low = mu, np.log([pi0_bounds[0], mu_bounds[0]])
        self.span = np.log([pi0_bounds[1], mu_bounds[1]]) - self.low

    def unpack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pi0, mu and weights of parameter sets in free coordinates."""
        box = np.exp(self.low + self.span / (1 + np.exp(-x[:, :2])))
        if self.fixed_mu is not None:
            box[:, 1] = self.fixed_mu
        weight = np.zeros((len(x), len(self.cells)))
        for k in range(len(self.features)):
            z = x[:, 2:][:, self.of == k]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            weight[:, self.of == k] = e / e.sum(axis=1, keepdims=True)
        return box[:, 0], box[:, 1], weight

    def natural(self, x: np.ndarray) -> np.ndarray:
        pi0, mu, weight = self.unpack(x)
        return np.column_stack([np.log(pi0), mu[:, None] * weight])

    def free(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Gradient in free coordinates from that in natural ones."""
        _, _, weight = self.unpack(x)
        inner = 1 / (1 + np.exp(-x[:, :2]))
        d = self.span * inner * (1 - inner)
        if self.fixed_mu is not None:
            d[:, 1] = 0
        part = g[:, 1:] * self.natural(x)[:, 1:]
        same = self.of[:, None] == self.of[None, :]
        return np.column_stack([d[:, 0] * g[:, 0], d[:, 1] * part.sum(axis=1), part - weight * (part @ same)])

    def allowed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A, b, G, h of the set allowed: A theta = b and G theta <= h."""
        member = np.array([[0.0, *(self.of == k)] for k in range(len(self.features))])
        one = np.eye(1, 1 + len(self.cells))
        ends = np.exp([self.low[1], self.low[1] + self.span[1]])
        sides = [(-one, -self.low[0]), (one, self.low[0] + self.span[0]), (-np.eye(1 + len(self.cells))[1:], 0.0)]
        if self.fixed_mu is not None:
            equal, value = member, np.full(len(member), self.fixed_mu)
        else:
            equal, value = member[1:] - member[0], np.zeros(len(member) - 1)
            sides += [(-member[:1], -ends[0]), (member[:1], ends[1])]
        return equal, value, np.concatenate([g for g, _ in sides]), np.concatenate([np.full(len(g), v) for g, v in sides])

    def inside(self, theta: np.ndarray) -> np.ndarray:
        """The rounding of a solver taken off: bounds met, and each feature's weights summing to one mu."""
        theta = np.clip(theta, [self.low[0], *[0.0] * len(self.cells)], [self.low[0] + self.span[0], *[np.inf] * len(self.cells)])
        sums = np.column_stack([theta[:, 1:][:, self.of == k].sum(axis=1) for k in range(len(self.features))])
        mu = np.clip(sums[:, :1], *np.exp([self.low[1], self.low[1] + self.span[1]])) if self.fixed_mu is None else np.full((len(theta), 1), self.fixed_mu)
        theta[:, 1:] *= (mu / np.maximum(sums, 1e-300))[:, self.of]
        return theta

    def gap(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        """A bound on how far nll is above its least value: the fall of its tangent plane over the convex set allowed."""
        ends = np.array([self.low, self.low + self.span])
        mu = np.exp(ends[:, 1]) if self.fixed_mu is None else np.array([self.fixed_mu])
        least = sum(g[:, 1:][:, self.of == k].min(axis=1) for k in range(len(self.features)))
        return (g[:, :1] * (theta[:, :1] - ends[None, :, 0])).max(axis=1) + (g[:, 1:] * theta[:, 1:]).sum(axis=1) - (mu[None, :] * least[:, None]).min(axis=1)

    def direction(self, theta, g, h, nll, tolerance: float) -> np.ndarray:
        """From each set towards the least point of its second-order expansion over the set allowed."""
        if not len(theta):
            return theta
        return self.inside(least_quadratic(g, h, theta, *self.allowed(), 1e-2 * tolerance * np.maximum(1, np.abs(nll)))) - theta

    def unfold(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nll, gradient and Hessian from rows of sums."""
        size = 1 + len(self.cells)
        upper = np.triu_indices(size)
        hess = np.zeros((len(total), size, size))
        hess[:, upper[0], upper[1]] = hess[:, upper[1], upper[0]] = total[:, 1 + size :]
        return total[:, 0], total[:, 1 : 1 + size], hess


#: Parameter sets whose sums travel together, and tasks whose sums are added before they meet the others'.
SETS, FAN = 64, 32


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the packed arrays of each key, one array in memory at a time."""

    def run(batches):
        key, total = None, None
        for b in batches:
            for k, packed in zip(zip(*[b.column(c).to_pylist() for c in keys]), b.column("packed").to_pylist()):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"b": [key[0]], "packed": [total.tobytes()]}, schema=_PACKED)
                    key, total = k, np.frombuffer(packed).copy()
                else:
                    total += np.frombuffer(packed)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"b": [key[0]], "packed": [total.tobytes()]}, schema=_PACKED)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "b int, packed binary")


_PACKED = pa.schema([("b", pa.int32()), ("packed", pa.binary())])


def _stacked(packed: DataFrame, many: int, width: int) -> np.ndarray:
    """The arrays of all blocks one below the other; zeros where there are no windows."""
    rows = sorted(packed.collect(), key=lambda r: r["b"])
    return np.concatenate([np.frombuffer(r["packed"]) for r in rows]).reshape(many, width) if rows else np.zeros((many, width))


class Fit:
    """Maximum likelihood from many starts at once, optionally leaving out each group of windows in turn.

    Windows hold their slopes as one array and stay cached.  An iteration is one pass: every task multiplies its
    windows with all parameter sets and returns sums of likelihood, gradient and Hessian, packed for ``SETS`` sets in a row; these rows
    are added in two levels, and where a block's sums meet, its sets' next steps are found too.  So Hessians stay on
    executors, and the driver holds some numbers for each parameter of each set: the starts, or one set for each left-out group.
    """

    def __init__(self, slopes: DataFrame, windows: DataFrame, group: str | None = None, mu: float | None = None, pi0_bounds=(1e-4, 0.6), mu_bounds=(1e-11, 1e-5)):
        cells = [tuple(r) for r in slopes.select("ti", "feature").distinct().orderBy("feature", "ti").collect()]
        self.shape = Coordinates(cells, mu, pi0_bounds, mu_bounds)
        order = F.array_sort(F.collect_list(F.struct("feature", "ti", "a")))
        a = slopes.groupBy("chrom", "bin").agg(F.transform(order, lambda s: s["a"]).alias("a"))
        keep = ["chrom", "bin", "n_same", "n_diff"]
        keep += [group] if group and group not in keep else []
        w = windows.filter("n_same + n_diff > 0").select(*keep).join(a, ["chrom", "bin"])
        number = lambda c: F.col(c).cast("double").alias(c)
        self.data = w.select(number("n_same"), number("n_diff"), "a", (F.col(group) if group else F.lit(None)).cast("string").alias("group")).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.data.select(F.spark_partition_id().alias("p")).distinct().count()
        self.groups = sorted(r[0] for r in self.data.select("group").distinct().collect() if r[0] is not None) if group else []

    def _sums(self, theta: np.ndarray, left_out: list[str | None]) -> DataFrame:
        """(b, packed): nll, gradient and the upper half of the Hessian in (log pi0, mu * weights) of block b of parameter sets, over
        windows outside each set's left-out group.

        nll is convex in these coordinates, and so is the set of those allowed.
        """
        names = {g: i for i, g in enumerate(sorted({g for g in left_out if g is not None}))}
        out = np.array([-1 if g is None else names[g] for g in left_out])
        shared = self.data.sparkSession.sparkContext.broadcast((theta, out, names))
        size = theta.shape[1]
        upper = np.triu_indices(size)

        def run(batches):
            theta, out, names = shared.value
            total = np.zeros((len(theta), 1 + size + len(upper[0])))
            for b in batches:
                a = b.column("a").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size - 1)
                v = np.column_stack([np.ones(len(a)), -a])
                outer = v[:, upper[0]] * v[:, upper[1]]
                code = np.array([names.get(g, -2) for g in b.column("group").to_pylist()])
                diff, same = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("n_diff", "n_same"))
                for at in range(0, len(theta), 4 * SETS):
                    own = slice(at, at + 4 * SETS)
                    pi = np.clip(np.exp(v @ theta[own].T), 1e-12, 1 - 1e-12)
                    used = code[:, None] != out[None, own] if (out[own] >= 0).any() else 1.0
                    d, n = diff * used, same * used
                    total[own, 0] += -(d * np.log(pi) + n * np.log1p(-pi)).sum(axis=0)
                    total[own, 1 : 1 + size] += -(d - n * pi / (1 - pi)).T @ v
                    total[own, 1 + size :] += (n * pi / (1 - pi) ** 2).T @ outer
            for k, at in enumerate(range(0, len(theta), SETS)):
                yield pa.RecordBatch.from_pydict({"b": [k], "packed": [total[at : at + SETS].tobytes()]}, schema=_PACKED)

        parts = self.data.mapInArrow(run, "b int, packed binary")
        if self.tasks > FAN:
            parts = _added(parts.withColumn("fan", F.spark_partition_id() % (-(-self.tasks // FAN))), "b", "fan")
        return _added(parts, "b")

    def sums(self, theta: np.ndarray, left_out: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nll, gradient and Hessian of a few parameter sets, on the driver."""
        size = theta.shape[1]
        return self.shape.unfold(_stacked(self._sums(theta, left_out), len(theta), 1 + size + size * (size + 1) // 2))

    def evaluate(self, x: np.ndarray, left_out: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """nll and its gradient in free coordinates for each parameter set, over windows outside its left-out group."""
        nll, g, _ = self.sums(self.shape.natural(x), left_out)
        return nll, self.shape.free(x, g)

    def steps(self, theta: np.ndarray, left_out: list[str | None], nll: np.ndarray, gap: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each trial set: nll, gap, whether it is better than the earlier ``nll`` and ``gap``, and where to go from it."""
        shape, shared = self.shape, self.data.sparkSession.sparkContext.broadcast((theta, nll, gap))

        def run(batches):
            theta, nll, gap = shared.value
            for b in batches:
                for k, packed in zip(b.column("b").to_pylist(), b.column("packed").to_pylist()):
                    own = slice(k * SETS, (k + 1) * SETS)
                    new, g, h = shape.unfold(np.frombuffer(packed).reshape(len(theta[own]), -1))
                    left = shape.gap(theta[own], g)
                    # where nll falls by less than its rounding, the bound tells
                    better = (new < nll[own]) | ((new <= nll[own] + 1e-12 * np.abs(nll[own])) & (left < gap[own]))
                    move = np.zeros_like(theta[own])
                    move[better] = shape.direction(theta[own][better], g[better], h[better], new[better], tolerance)
                    out = np.column_stack([new, left, better, move])
                    yield pa.RecordBatch.from_pydict({"b": [k], "packed": [out.tobytes()]}, schema=_PACKED)

        out = _stacked(self._sums(theta, left_out).mapInArrow(run, "b int, packed binary"), len(theta), 3 + theta.shape[1])
        return out[:, 0], out[:, 1], out[:, 2] > 0, out[:, 3:]

    def minimise(self, theta: np.ndarray, left_out: list[str | None], iterations: int, tolerance: float, survivors: int | None = None) -> tuple:
        """theta, nll, converged, passes and dropped.

        A step goes towards the least point of the second-order expansion over the set allowed, and is shortened until
        nll falls.  A set that has converged takes no further pass.  All sets of one left-out group have the same least nll, as nll is
        convex; with ``survivors`` only so many of least nll go on in each group, and none once one has converged.
        """
        theta, many = theta.copy(), len(theta)
        problem = np.unique([g or "" for g in left_out], return_inverse=True)[1]
        nll, gap, _, move = self.steps(theta, left_out, np.full(many, np.inf), np.full(many, np.inf), tolerance)
        step, passes, dropped = np.ones(many), np.ones(many, int), np.zeros(many, bool)
        done = gap <= tolerance * np.maximum(1, np.abs(nll))
        for _ in range(iterations):
            if survivors:
                order = np.lexsort((nll, ~done, problem))  # converged sets first in each group
                place = np.empty(many, int)
                place[order] = np.arange(many) - np.searchsorted(problem[order], problem[order])
                over = np.isin(problem, problem[done])
                dropped |= ~done & ((place >= survivors) | over)
            at = np.flatnonzero(~done & ~dropped & (step > 1e-9))
            if not len(at):
                break
            trial = theta[at] + step[at, None] * move[at]
            new, left, better, onward = self.steps(trial, [left_out[i] for i in at], nll[at], gap[at], tolerance)
            passes[at] += 1
            step[at] = np.where(better, 1.0, step[at] * 0.25)
            b = at[better]
            theta[b], nll[b], gap[b], move[b] = trial[better], new[better], left[better], onward[better]
            done[b] = gap[b] <= tolerance * np.maximum(1, np.abs(nll[b]))
            # a set below one that has converged is as near to the least
            least = np.full(problem.max() + 1, -np.inf)
            np.maximum.at(least, problem[done], nll[done])
            done |= nll <= least[problem]
        return theta, nll, done, passes, dropped

    def run(self, starts: int, iterations: int = 500, seed: int = 1, leave_out: bool = False, tolerance: float = 1e-10, survivors: int | None = None, groups: list[str] | None = None, full: bool = False) -> list[dict]:
        """Parameter set of every start, or of every left-out group (of ``groups``, if given), which starts from the best of the full fits.

        A fit has converged when nll is within ``tolerance`` of its size from the least; ``iterations`` is only a
        safety limit, and a fit that meets it says so.  ``survivors`` is for thousands of starts (see ``minimise``); ``full`` adds the best full fit to the left-out ones.
        """
        x = np.random.default_rng(seed).normal(0, 1, (starts, 2 + len(self.shape.cells)))
        left_out: list[str | None] = [None] * starts
        found = self.minimise(self.shape.natural(x), left_out, iterations, tolerance, survivors)
        if leave_out:
            best = int(np.argmin(found[1]))
            first = [[v[best]] for v in found] if full else None
            left_out = [*(self.groups if groups is None else groups)]
            found = self.minimise(np.repeat(found[0][[best]], len(left_out), axis=0), left_out, iterations, tolerance) if left_out else tuple(v[:0] for v in found)
            if first:
                left_out, found = [None, *left_out], tuple(np.concatenate([a, b]) for a, b in zip(first, found))
        theta, nll, converged, passes, dropped = found
        pi0, mu = np.exp(theta[:, 0]), theta[:, 1:][:, self.shape.of == 0].sum(axis=1)
        weight = theta[:, 1:] / mu[:, None]
        return [
            {"theta_id": i, "left_out": g, "nll": float(nll[i]), "pi0": float(pi0[i]), "mu": float(mu[i]), "weights": weight[i].tolist(), "converged": bool(converged[i]), "iterations": int(passes[i]), "dropped": bool(dropped[i])}
            for i, g in enumerate(left_out)
        ]

    def table(self, spark, fits: list[dict]) -> DataFrame:
        """Fits as theta rows (theta_id, left_out, nll, pi0, mu, converged, iterations, ti, feature, weight)."""
        rows = [(f["theta_id"], f["left_out"], f["nll"], f["pi0"], f["mu"], f["converged"], f["iterations"], t, name, w) for f in fits for (t, name), w in zip(self.shape.cells, f["weights"])]
        return spark.createDataFrame(rows, "theta_id int, left_out string, nll double, pi0 double, mu double, converged boolean, iterations int, ti int, feature string, weight double")

    def close(self) -> None:
        self.data.unpersist()


def jackknife_blocks(windows: DataFrame, k: int, moving: bool = True) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``k`` consecutive windows of a chromosome, and the windows that some block holds.

    Blocks: (block, chrom, first, size, lost, left_out), where ``block`` numbers them in natural order of chromosomes, ``first`` is the number of
    the first window in its chromosome, ``lost`` how many windows no other block holds, and ``left_out`` names them (null: none).  Windows: with
    ``nth``, their number in the chromosome, and ``left_out`` where one block alone holds them.  ``moving``: a block starts at
    every window, as long as ``k`` windows follow; else blocks are disjoint and the last of a chromosome may be shorter.
    """
    sizes = windows.groupBy("chrom").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(0), F.col("n") - k + 1) if moving else F.ceil(F.col("n") / k)).filter("blocks > 0")
    before = F.coalesce(F.sum("blocks").over(W.orderBy(chrom_key(F.col("chrom"))).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each chromosome
    sizes = sizes.withColumn("before", before)
    w = scans.numbered(windows, ["chrom"], "bin", "nth").join(sizes.select("chrom", "n"), "chrom")
    alone = F.col("nth") - F.col("nth") % k
    if moving:
        low, high = F.greatest(F.lit(0), F.col("nth") - k + 1), F.least(F.col("nth"), F.col("n") - k)
        alone = F.when(low == high, low)
    name = F.concat("chrom", F.lit(":"), alone.cast("string"))
    w = w.withColumn("left_out", name).drop("n")
    lost = w.filter("left_out IS NOT NULL").groupBy("left_out").agg(F.count("*").alias("lost"))
    each = sizes.select("chrom", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    first = F.col("i") if moving else F.col("i") * k
    each = each.select((F.col("before") + F.col("i")).alias("block"), "chrom", first.alias("first"), F.least(F.lit(k), F.col("n") - first).cast("int").alias("size"))
    each = each.withColumn("name", F.concat("chrom", F.lit(":"), F.col("first").cast("string"))).join(lost, F.col("name") == F.col("left_out"), "left")
    return each.select("block", "chrom", "first", "size", F.coalesce("lost", F.lit(0)).alias("lost"), "left_out"), w


def jackknife(slopes: DataFrame, windows: DataFrame, k: int, moving: bool = True, number: int | None = None, fraction: float | None = None, starts: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """Delete-one-block fits: blocks with (retained, theta_id, nll, pi0, mu, converged, r), and theta rows by theta_id.

    A block's fit is over the windows that other blocks hold.  With moving blocks hardly any block loses a window, so fits are
    made for the distinct sets of lost windows only and all other blocks share the full fit: the number of fits follows the chromosomes, not the
    blocks.  ``number`` or ``fraction`` (of the blocks) asks for one block.  ``r``: correlation of predicted and observed pi over
    the block's own windows.
    """
    blocks, w = jackknife_blocks(windows, k, moving)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    if fraction is not None:
        number = int(fraction * blocks.count())
    if number is not None:
        blocks = blocks.filter(F.col("block") == number)
    f = Fit(slopes, w, "left_out", **options)
    total = f.data.count()
    names = [r[0] for r in blocks.filter("left_out IS NOT NULL").select("left_out").distinct().collect()]  # a fit for each
    known = set(f.groups)
    theta = f.table(windows.sparkSession, f.run(starts, leave_out=True, groups=sorted(x for x in names if x in known), full=True))
    held = f.data.groupBy("group").agg(F.count("*").alias("gone")).collect()
    f.close()
    gone = windows.sparkSession.createDataFrame([(r["group"], r["gone"]) for r in held if r["group"] in set(names)], "left_out string, gone long")
    fits = theta.select("theta_id", F.col("left_out").alias("fit"), "nll", "pi0", "mu", "converged").distinct()
    # a block that loses nothing, or only windows without data, has the full fit
    blocks = blocks.join(F.broadcast(gone), "left_out", "left").withColumn("fit", F.when(F.col("gone") > 0, F.col("left_out")))
    blocks = blocks.alias("b").join(F.broadcast(fits.alias("f")), F.col("b.fit").eqNullSafe(F.col("f.fit"))).drop("fit")
    out = blocks.withColumn("retained", F.lit(total) - F.coalesce("gone", F.lit(0))).drop("gone")
    return out.join(_block_r(slopes, w, out, theta, k, moving), "block", "left"), theta


def _block_r(slopes: DataFrame, w: DataFrame, blocks: DataFrame, theta: DataFrame, k: int, moving: bool) -> DataFrame:
    """(block, r) by predictions of each block's fit for its own windows alone."""
    at = F.col("nth")
    starts = F.sequence(F.greatest(F.lit(0), at - k + 1), at) if moving else F.array(at - at % k)
    one = w.filter("pi IS NOT NULL").select("chrom", "bin", "pi", F.explode(starts).alias("first"))
    member = one.join(blocks.select("block", "chrom", "first", "theta_id"), ["chrom", "first"]).select("block", "theta_id", "chrom", "bin", F.col("pi").alias("observed"))
    need = member.select("theta_id", "chrom", "bin").distinct().join(slopes, ["chrom", "bin"]).join(F.broadcast(theta), ["theta_id", "ti", "feature"])
    x = need.groupBy("theta_id", "pi0", "mu", "chrom", "bin").agg(F.sum(F.col("weight") * F.col("a")).alias("x"))
    p = x.select("theta_id", "chrom", "bin", (F.col("pi0") * F.exp(-F.col("mu") * F.col("x"))).alias("predicted"))
    return member.join(p, ["theta_id", "chrom", "bin"]).groupBy("block").agg(S.correlation("predicted", "observed").alias("r"))


def best_by_group(theta: DataFrame) -> DataFrame:
    """The best start of each left-out group."""
    w = W.partitionBy("left_out").orderBy("nll", "theta_id")
    pick = theta.select("left_out", "theta_id", "nll").distinct().withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return theta.join(F.broadcast(pick.select("theta_id")), "theta_id", "left_semi")


def out_of_sample(theta: DataFrame, slopes: DataFrame, windows: DataFrame, group: str = "chrom") -> DataFrame:
    """Correlation of predictions with observations on each left-out group, by the fit that did not see it."""
    p = predict(slopes, theta).join(F.broadcast(theta.select("theta_id", "left_out").distinct()), "theta_id")
    j = p.join(windows.select("chrom", "bin", F.col("pi").alias("observed"), *([] if group == "chrom" else [group])), ["chrom", "bin"])
    j = j.filter((F.col(group).cast("string") == F.col("left_out")) & F.col("observed").isNotNull())
    return j.groupBy("left_out").agg(S.correlation("pi", "observed").alias("r"), F.count("*").alias("n"))


def average_r(by_group: DataFrame) -> DataFrame:
    """One row: the mean of ``out_of_sample``'s r over groups, each counted by its windows, and the windows."""
    ok = by_group.filter(F.col("r").isNotNull() & ~F.isnan("r"))
    return ok.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("r"), F.sum("n").alias("n"))


def parameter_labels(theta: DataFrame, t: list[float]) -> DataFrame:
    """(theta_id, name, value) with names pi0, mu and W[log10 t,feature]."""
    ts = F.array(*[F.lit(f"{np.log10(x):g}") for x in t])
    w = theta.select("theta_id", F.concat(F.lit("W["), ts[F.col("ti")], F.lit(","), F.col("feature"), F.lit("]")).alias("name"), F.col("weight").alias("value"))
    two = theta.select("theta_id", "pi0", "mu").distinct().unpivot(["theta_id"], ["pi0", "mu"], "name", "value")
    return two.unionByName(w)


def labelled_parameters(labels: DataFrame, t: list[float]) -> DataFrame:
    """Theta rows (theta_id, pi0, mu, ti, feature, weight) back from ``parameter_labels``."""
    ts = F.array(*[F.lit(f"{np.log10(x):g}") for x in t])
    part = lambda k: F.regexp_extract("name", r"^W\[([^,]*),(.*)\]$", k)
    w = labels.filter(F.col("name").startswith("W[")).select("theta_id", (F.array_position(ts, part(1)) - 1).cast("int").alias("ti"), part(2).alias("feature"), F.col("value").alias("weight"))
    two = labels.groupBy("theta_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("pi0", "mu")])
    return w.join(two, "theta_id").select("theta_id", "pi0", "mu", "ti", "feature", "weight")
