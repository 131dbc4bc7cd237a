"""Many linear heads fitted together, from sums that merge.

A fit is a head, a set of feature columns, a training group and a regularisation.
One pass over the rows sums a Gram matrix of (1, features, label) per column set,
group and class of the label. Those matrices add up over tasks, and from them follow,
for every fit: row counts, class weights and centres, means and spreads of the
columns, the ridge solution for any regularisation, and an upper bound of the loss's
curvature. Heads without a closed form take rounds: in each, one pass sums loss and
gradient of all unfinished fits at once, and the driver moves each fit. Class heads of
moderate size also sum their curvature, the same Gram matrix weighted by each row's
probabilities, and take Newton steps; others take quasi-Newton steps whose first metric
is the bound. A step that does not lower the loss is replaced by the bound's own, which
always does.

So the number of passes is that of the slowest fit, not of fits times rounds, and rows
are shuffled never: only sums are, of a size that depends on columns and classes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS, SEVERITY_CLASSES
from assaymill.functions.who import severity_band, severity_index
from assaymill.operators.training import WEIGHT_EPS
from assaymill.session import written

CLASSES = {"binary": 2, "severity": len(SEVERITY_CLASSES)}
PARTIAL = "key int, slab int, part int, sums binary"
SLAB = 1 << 16  # doubles of one merged value
COLLECT_BYTES = 16 << 20
NEWTON_SIZE = 600  # coefficients of one fit up to which its curvature is summed
MEMORY = 8  # steps that a quasi-Newton direction remembers
MIN_SPREAD = 1e-12


@dataclass(frozen=True)
class Spec:
    """What to fit: ``group`` names the training rows, ``columns`` the features."""

    name: str
    head: str
    regularisation: float
    columns: tuple[int, ...]
    group: str = "train"


@dataclass
class Solution:
    """Coefficients on the raw features, the intercept first; one column per class or one."""

    spec: Spec
    n: int
    coef: np.ndarray
    centres: tuple[float, ...] = ()
    rounds: int = 0
    converged: bool = True
    decrement: float = 0.0


def prepared(rows: DataFrame, group: str, cfg: AuditConfig) -> DataFrame:
    """The columns a fit reads, written once because rounds read them again and again."""
    band = severity_index(severity_band(F.col("y"), F.col("sex"), cfg))
    return written(
        rows.where("y IS NOT NULL").select(
            F.col(group).cast("string").alias("_g"), F.col("features").cast("array<double>").alias("_x"), F.col("y").cast("double").alias("_y"), (F.col("y") < cfg.cut_male).cast("int").alias("_b"), band.alias("_s")
        )
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows by features; a missing value is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("_x")
    if x.null_count:
        batch = batch.filter(x.is_valid())
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return get("_g"), _matrix(batch.column("_x")), get("_y").astype(float), get("_b"), get("_s")


def merged(rows: DataFrame, add: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None], values: int) -> dict[int, np.ndarray]:
    """Sum, over all rows, what ``add`` adds up per key; ``values`` is the number of doubles of one task.

    The sums of tasks meet on the driver while they are few; otherwise executors add
    them up first, in two rounds, so that no task reads more than about the root of them.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                add(batch, sums)
        part = TaskContext.get().partitionId()
        for key, total in sums.items():
            for slab in range(-(-len(total) // SLAB)):
                piece = total[slab * SLAB : (slab + 1) * SLAB]
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "slab": pa.array([slab], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([piece.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, PARTIAL)
    tasks = rows.rdd.getNumPartitions()
    if tasks * values * 8 > COLLECT_BYTES:
        fan = max(1, int(tasks**0.5))
        sums = sums.withColumn("part", F.col("part") % fan).groupBy("key", "slab", "part").applyInArrow(_added, PARTIAL).groupBy("key", "slab").applyInArrow(_added, PARTIAL)
    pieces: dict[tuple[int, int], np.ndarray] = {}
    for batch in sums.toArrow().to_batches():
        for key, slab, data in zip(*(batch.column(c).to_pylist() for c in ("key", "slab", "sums"))):
            piece = np.frombuffer(data)
            pieces[key, slab] = pieces[key, slab] + piece if (key, slab) in pieces else piece
    out: dict[int, list[np.ndarray]] = {}
    for key, slab in sorted(pieces):
        out.setdefault(key, []).append(pieces[key, slab])
    return {key: np.concatenate(parts) for key, parts in out.items()}


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
    return pa.table({"key": table.column("key")[:1], "slab": table.column("slab")[:1], "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


@dataclass
class _Grams:
    """Gram matrices of one column set and group, by class cell of the label."""

    cells: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def total(self, weight: Callable[[tuple[int, int]], float] = lambda cell: 1.0) -> np.ndarray:
        return sum((weight(c) * g for c, g in self.cells.items()), 0.0)


def _grams(data: DataFrame, sets: list[tuple[tuple[int, ...], str]]) -> list[_Grams]:
    bands = len(SEVERITY_CLASSES)
    layout = [(np.array(columns, int), group) for columns, group in sets]

    def add(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        g, x, y, b, s = _rows(batch)
        cell = b.astype(int) * bands + s.astype(int)
        for k, (columns, group) in enumerate(layout):
            z = np.column_stack([np.ones(len(y)), x[:, columns], y])
            usable = (g == group) & np.isfinite(z).all(axis=1)
            for c in np.unique(cell[usable]):
                one = z[usable & (cell == c)]
                key = k * 2 * bands + int(c)
                sums[key] = sums.get(key, 0.0) + (one.T @ one).ravel()

    size = sum((len(c) + 2) ** 2 for c, _ in sets) * 2 * bands
    found = [_Grams() for _ in sets]
    for key, flat in merged(data, add, size).items():
        k, cell = divmod(key, 2 * bands)
        d = len(sets[k][0]) + 2
        found[k].cells[divmod(cell, bands)] = flat.reshape(d, d)
    return found


def _targets(head: str, classes: Sequence[int], y: np.ndarray, b: np.ndarray, s: np.ndarray, cfg: AuditConfig) -> np.ndarray:
    if head == "ordinal":
        score = -0.5 * ((y[:, None] - np.array(cfg.centres)) / cfg.soft_sigma) ** 2
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return (np.asarray(b if head == "binary" else s)[:, None] == np.array(classes)).astype(float)


def _loss(head: str, z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the loss, its derivative by each row's outputs, and the class probabilities."""
    if head == "regression":
        r = z - t
        a = np.abs(r)
        return float((weight * np.where(a < 1, 0.5 * a * a, a - 0.5)[:, 0]).sum()), weight[:, None] * np.clip(r, -1, 1), z
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    s = e.sum(axis=1, keepdims=True)
    return float((weight * (np.log(s[:, 0]) + top[:, 0] - (t * z).sum(axis=1))).sum()), weight[:, None] * (e / s - t), e / s


def _curvature(z: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Second derivatives by (class, coefficient) twice: Gram matrices weighted by the probabilities."""
    k, d = p.shape[1], z.shape[1]
    out = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a + 1):
            block = z.T @ (z * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None])
            out[a, :, b, :] = out[b, :, a, :] = block
    return out.ravel()


class _Fit:
    """One fit under way, in standardised coordinates."""

    def __init__(self, spec: Spec, grams: _Grams, cfg: AuditConfig) -> None:
        plain = grams.total()
        if np.isscalar(plain):
            raise ValueError(f"fit {spec.name!r} has no training row")
        n, d = plain[0, 0], len(spec.columns)
        self.spec, self.n = spec, n
        self.mean = plain[0, 1 : d + 1] / n
        spread = np.sqrt(np.maximum(np.diag(plain)[1 : d + 1] / n - self.mean**2, 0.0))
        self.inverse = np.where(spread > MIN_SPREAD, 1.0 / np.maximum(spread, MIN_SPREAD), 0.0)
        self.penalty = np.concatenate([[0.0], np.full(d, spec.regularisation)])
        weights = np.ones(1)
        self.classes, self.centres = (), ()
        if spec.head in CLASSES:
            of = (lambda c: c[0]) if spec.head == "binary" else (lambda c: c[1])
            k = CLASSES[spec.head]
            counts, sums = np.zeros(k), np.zeros(k)
            for cell, g in grams.cells.items():
                counts[of(cell)] += g[0, 0]
                sums[of(cell)] += g[0, -1]
            raw = np.where(counts > 0, 1.0 / (counts / n + WEIGHT_EPS), 1.0)
            weights = raw / max((counts / n * raw).sum(), WEIGHT_EPS)
            # A class without members is not fitted: its probability is zero.
            self.classes = tuple(int(c) for c in np.flatnonzero(counts))
            self.centres = tuple(np.where(counts > 0, sums / np.maximum(counts, 1), plain[0, -1] / n))
            curved = 0.5 * grams.total(lambda cell: weights[of(cell)])
        elif spec.head == "ordinal":
            self.classes, self.centres = tuple(range(len(cfg.centres))), tuple(cfg.centres)
            curved = 0.5 * plain
        else:
            curved = plain
        self.weights = weights
        to = self.into()
        bound = to.T @ curved[: d + 1, : d + 1] @ to / n + np.diag(self.penalty)
        bound[np.diag_indices(d + 1)] += np.where(np.concatenate([[1.0], self.inverse]) == 0, 1.0, 1e-12)
        self.solve = np.linalg.inv(bound)
        self.point = np.zeros((d + 1, max(1, len(self.classes))))
        self.right = to.T @ plain[: d + 1, -1:] / n
        self.at, self.done, self.rounds, self.decrement = None, False, 0, np.inf
        self.history: list[tuple[np.ndarray, np.ndarray]] = []
        self.newton = bool(self.classes) and self.point.size <= NEWTON_SIZE
        if spec.head == "ridge":
            self.point, self.done, self.decrement = self.solve @ self.right, True, 0.0
        elif spec.head == "regression":
            self.point = self.solve @ self.right  # the ridge solution is close

    def into(self) -> np.ndarray:
        """Standardised = raw @ this."""
        out = np.diag(np.concatenate([[1.0], self.inverse]))
        out[0, 1:] = -self.mean * self.inverse
        return out

    def raw(self) -> np.ndarray:
        return self.into() @ self.point

    def values(self) -> int:
        """Doubles that one round sums for this fit."""
        return 1 + self.point.size + self.newton * self.point.size**2

    def move(self, sums: np.ndarray, cfg: AuditConfig) -> None:
        """Take the sums at ``point``, and choose the next point."""
        self.rounds += 1
        total, slope = sums[0], sums[1 : 1 + self.point.size].reshape(self.point.shape)
        value = total / self.n + 0.5 * float((self.penalty[:, None] * self.point**2).sum())
        g = self.into().T @ slope / self.n + self.penalty[:, None] * self.point
        if self.at is not None and value > self.at[0] + 1e-4 * self.at[3]:
            if self.at[4]:
                # Not even the bound's own step lowers the loss: rounding is all that is left.
                self.point, self.done = self.at[1], True
                return
            _, start, slope_there, *_ = self.at
            self.history.clear()
            step = -self.solve @ slope_there
            self.at = (self.at[0], start, slope_there, float((slope_there * step).sum()), True)
            self.point = start + step
            return
        if self.at is not None:
            s, y = self.point - self.at[1], g - self.at[2]
            if (s * y).sum() > 1e-14:
                self.history = [*self.history[1 - MEMORY :], (s, y)]
        own = self._newton_step(sums[1 + self.point.size :], g) if self.newton else self.solve @ g
        self.decrement = float((g * own).sum()) / 2
        if self.decrement <= cfg.fit_tolerance * max(1.0, abs(value)):
            self.done = True
            return
        step = -own if self.newton else -self._direction(g)
        if (g * step).sum() >= 0:
            step = -self.solve @ g
        self.at = (value, self.point, g, float((g * step).sum()), not self.newton and not self.history)
        self.point = self.point + step

    def _newton_step(self, curved: np.ndarray, g: np.ndarray) -> np.ndarray:
        d, k = self.point.shape
        to = self.into()
        h = np.einsum("pi,apbq,qj->aibj", to, curved.reshape(k, d, k, d), to, optimize=True) / self.n
        h = h.reshape(k * d, k * d)
        # Adding one constant to all classes changes nothing: that direction has no curvature.
        h[np.diag_indices(k * d)] += np.tile(self.penalty, k) + 1e-10 * max(1.0, np.trace(h) / (k * d))
        h[np.diag_indices(k * d)] += np.tile(np.concatenate([[1.0], self.inverse]) == 0, k)
        return np.linalg.solve(h, g.T.ravel()).reshape(k, d).T

    def _direction(self, g: np.ndarray) -> np.ndarray:
        """The two-loop recursion of limited-memory BFGS over the bound's inverse."""
        q, kept = g.copy(), []
        for s, y in reversed(self.history):
            a = (s * q).sum() / (s * y).sum()
            kept.append(a)
            q = q - a * y
        r = self.solve @ q
        for (s, y), a in zip(self.history, reversed(kept)):
            r = r + s * (a - (y * r).sum() / (s * y).sum())
        return r


def fit_many(rows: DataFrame, specs: Sequence[Spec], group: str = "split", cfg: AuditConfig = DEFAULTS) -> list[Solution]:
    """Fit all ``specs`` on rows with ``features`` (array), ``y``, ``sex`` and the column ``group``.

    A row with a missing value in a column of a fit is no training row of that fit;
    other fits still use it. Features are standardised by the training rows of each
    fit, and a column without spread gets no coefficient.
    """
    data = prepared(rows, group, cfg)
    sets = list(dict.fromkeys((s.columns, s.group) for s in specs))
    grams = dict(zip(sets, _grams(data, sets)))
    fits = [_Fit(s, grams[s.columns, s.group], cfg) for s in specs]
    for _ in range(cfg.fit_iterations):
        todo = [k for k, f in enumerate(fits) if not f.done]
        if not todo:
            break
        sums = merged(data, _gradients([fits[k] for k in todo], cfg), sum(fits[k].values() for k in todo))
        for place, k in enumerate(todo):
            fits[k].move(sums[place], cfg)
    out = []
    for f in fits:
        coef = f.raw()
        centres = f.centres
        if f.spec.head in CLASSES:
            centres = tuple(centres[c] for c in f.classes)
        out.append(Solution(f.spec, int(f.n), coef, centres, f.rounds, f.done, f.decrement))
    return out


def _gradients(fits: list[_Fit], cfg: AuditConfig) -> Callable[[pa.RecordBatch, dict[int, np.ndarray]], None]:
    shared: dict[tuple[tuple[int, ...], str], list[tuple[int, str, tuple[int, ...], np.ndarray, np.ndarray, bool]]] = {}
    for k, f in enumerate(fits):
        shared.setdefault((f.spec.columns, f.spec.group), []).append((k, f.spec.head, f.classes, f.weights, f.raw(), f.newton))
    layout = [(np.array(columns, int), group, members) for (columns, group), members in shared.items()]

    def add(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        g, x, y, b, s = _rows(batch)
        for columns, group, members in layout:
            z = np.column_stack([np.ones(len(y)), x[:, columns]])
            usable = (g == group) & np.isfinite(z).all(axis=1) & np.isfinite(y)
            z, own = z[usable], (y[usable], b[usable], s[usable])
            outputs = z @ np.concatenate([m[4] for m in members], axis=1)
            at = 0
            for k, head, classes, weights, coef, newton in members:
                out = outputs[:, at : at + coef.shape[1]]
                at += coef.shape[1]
                target = own[0][:, None] if head == "regression" else _targets(head, classes, *own, cfg)
                weight = weights[np.asarray(own[1] if head == "binary" else own[2], int)] if head in CLASSES else np.ones(len(z))
                value, slope, p = _loss(head, out, target, weight)
                more = [_curvature(z, p, weight)] if newton else []
                sums[k] = sums.get(k, 0.0) + np.concatenate([[value], (z.T @ slope).ravel(), *more])

    return add


def _values(solution: Solution, z: np.ndarray) -> np.ndarray:
    out = z @ solution.coef
    if not solution.centres:
        return out[:, 0]
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return e @ np.array(solution.centres) / e.sum(axis=1)


def score_many(rows: DataFrame, solutions: Sequence[Solution]) -> list[dict[str, float]]:
    """Count, error and fit of all ``solutions`` on ``rows``, in one pass; None where undefined."""
    layout = [(np.array(s.spec.columns, int), s) for s in solutions]

    def add(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        x, y = _matrix(batch.column("_x")), batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
        for k, (columns, s) in enumerate(layout):
            z = np.column_stack([np.ones(len(y)), x[:, columns]])
            usable = np.isfinite(z).all(axis=1) & np.isfinite(y)
            t = y[usable]
            e = _values(s, z[usable]) - t
            sums[k] = sums.get(k, 0.0) + np.array([len(t), e.sum(), np.abs(e).sum(), e @ e, t.sum(), t @ t])

    data = rows.where("features IS NOT NULL").select(F.col("features").cast("array<double>").alias("_x"), F.col("y").cast("double").alias("_y"))
    sums = merged(data, add, 6 * len(layout))
    out = []
    for k in range(len(layout)):
        n, e, a, ee, t, tt = map(float, sums.get(k, np.zeros(6)))
        spread = tt - t * t / n if n else 0.0
        out.append({"n": int(n), "mae": a / n if n else None, "rmse": (ee / n) ** 0.5 if n else None, "bias": e / n if n else None, "r2": 1 - ee / spread if spread > 0 else None})
    return out
