"""L2 logistic regression of many models at once: every inverse regularisation and fold of a grid, one scan an iteration.

Each model minimises the mean loss of its rows plus |w|^2 / (2 c n); the intercept is not penalised. A scan evaluates
the trial point of every model that is not done on every row: tasks add up the models' losses and gradients, blocks of
terms are dealt to tasks that sum them, and one row for each block comes back, as the bytes of its numbers. The driver holds the models and takes each one's
next step (limited-memory BFGS with backtracking), so a model that is done, or has to shorten its step, delays no other.

The driver needs (2 x `HISTORY` + 4) numbers for each term and model; the vocabulary and the grid bound both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of steps and gradient changes that a model keeps; terms of a block; non-zero values handled at once.
HISTORY, BLOCK, VALUES = 10, 1024, 200_000


@dataclass(frozen=True)
class Spec:
    """A model: inverse regularisation c, and the fold whose rows it does not see."""

    c: float
    without: int | None = None


def sparse_rows(rows: DataFrame, *others: str) -> DataFrame:
    """label, terms, values and the other columns, of rows with `label` and a vector `features` (sparse or dense)."""
    v = F.unwrap_udt("features")
    terms = F.coalesce(v["indices"], F.transform(v["values"], lambda _, i: i))
    return rows.select(F.col("label").cast("double").alias("label"), terms.alias("terms"), v["values"].alias("values"), *others)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(labels, folds, row of each value, terms, values) of ranges of rows with some `VALUES` values each."""
    labels, folds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    terms, values = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + VALUES, side="right")))
        yield labels[first:last], folds[first:last], np.repeat(np.arange(last - first), sizes[first:last]), terms[base : ends[last - 1]], values[base : ends[last - 1]]
        first = last


PACKED = "labels binary, folds binary, places binary, terms binary, values binary"


def packed(rows: DataFrame) -> DataFrame:
    """Rows of `sparse_rows` with `fold`, some `VALUES` values at a time as the bytes of arrays, which scans read without converting them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, fold, row, terms, values in _parts(batch):
                arrays = (y.astype(float), fold.astype(np.int32), row.astype(np.int32), terms.astype(np.int32), values.astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=[c.split()[0] for c in PACKED.split(", ")])

    return rows.select("label", "terms", "values", "fold").mapInArrow(run, PACKED)


def scan(rows: DataFrame, points: np.ndarray, without: np.ndarray, only: bool = False, gradient: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows seen, summed loss, summed gradient) of every model over `packed` rows, at the models' points: a column each, the intercept last.

    without: each model's fold (-1: none) whose rows it does not see; with `only`, it sees those alone. A probability of
    less than 1e-15 counts as that much in a loss.
    """
    n_terms, n_models = points.shape[0] - 1, points.shape[1]
    most = -np.log(1 - (1 - 1e-15)), -np.log(1e-15)  # as probabilities held to 1e-15 and 1 - 1e-15 have it, for label 0 and 1
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(points.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = sent.value, np.zeros((n_models, n_terms + 1))
        seen, loss = np.zeros(n_models), np.zeros(n_models)
        for batch in batches:
            for block in zip(*batch.columns, strict=True):
                y, fold, row, terms, values = (np.frombuffer(x.as_buffer(), k) for x, k in zip(block, ("f8", "i4", "i4", "i4", "f8"), strict=True))
                margin = np.tile(w[:, -1], (len(y), 1))
                own = np.flatnonzero(np.diff(row, prepend=-1))  # where the values of a row begin
                for m in range(n_models if len(own) else 0):
                    margin[row[own], m] += np.add.reduceat(values * w[m].take(terms), own)
                inside = (fold[:, None] == without) if only else (fold[:, None] != without)
                seen += inside.sum(0)
                signed = np.where(y[:, None] > 0, -margin, margin)
                loss += (np.minimum(np.logaddexp(0, signed), np.where(y > 0, most[1], most[0])[:, None]) * inside).sum(0)
                if gradient:
                    off = (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y[:, None]) * inside
                    total[:, -1] += off.sum(0)
                    for m, x in enumerate(np.ascontiguousarray(off.T)):
                        total[m, :-1] += np.bincount(terms, values * x.take(row), minlength=n_terms)
        blocks = [(-1, np.concatenate([seen, loss, total[:, -1]]))]
        if gradient:
            blocks += [(i, x) for i in range(0, n_terms, BLOCK) if (x := total[:, i : min(i + BLOCK, n_terms)]).any()]
        yield _block_rows(blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer())
                sums[i] = sums[i] + x if i in sums else x.copy()
        yield _block_rows(list(sums.items()))

    schema = "block long, sums binary"
    parts = min(-(-n_terms // BLOCK) + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.mapInArrow(run, schema).repartition(parts, "block").mapInArrow(add, schema).toArrow()  # a row for each block
    sent.destroy()
    out = {i: np.frombuffer(x.as_buffer()) for i, x in zip(found["block"].to_pylist(), found["sums"], strict=True)}
    whole = np.zeros(points.shape)
    seen, loss, whole[-1] = out.pop(-1, np.zeros(3 * n_models)).reshape(3, n_models)
    for i, x in out.items():
        whole[i : min(i + BLOCK, n_terms)] = x.reshape(n_models, -1).T
    return seen, loss, whole


def _block_rows(blocks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int64()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], names=["block", "sums"])


@dataclass
class _Descent:
    """One model's search: its point, what it knows there, and the trial point that the next scan evaluates."""

    point: np.ndarray
    strength: float
    value: float = np.inf
    slope: np.ndarray | None = None
    step: float = 0.0
    way: np.ndarray | None = None
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.point if self.way is None or self.done else self.point + self.step * self.way

    def told(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """Takes in the mean loss and gradient at the trial point."""
        if self.done:
            return
        at = self.trial()
        value = loss + self.strength / 2 * float(at[:-1] @ at[:-1])
        slope = gradient.copy()
        slope[:-1] += self.strength * at[:-1]
        if self.way is not None:
            if value > self.value + 1e-4 * self.step * float(self.slope @ self.way):
                self.step /= 2
                self.done = self.step < 1e-12
                return
            change, turn = at - self.point, slope - self.slope
            if (bend := float(change @ turn)) > 1e-300:
                self.pairs = [*self.pairs, (change, turn, bend)][-HISTORY:]
        self.point, self.value, self.slope = at, value, slope
        self.done = float(np.abs(slope).max()) <= tolerance
        self._turn()

    def _turn(self) -> None:
        way, shares = -self.slope, []
        for change, turn, bend in reversed(self.pairs):
            shares.append(float(change @ way) / bend)
            way = way - shares[-1] * turn
        if self.pairs:
            _, turn, bend = self.pairs[-1]
            way = way * (bend / float(turn @ turn))
        for (change, turn, bend), share in zip(self.pairs, reversed(shares), strict=True):
            way = way + (share - float(turn @ way) / bend) * change
        if float(way @ self.slope) >= 0:
            self.pairs, way = [], -self.slope
        self.way, self.step = way, 1.0 if self.pairs else min(1.0, 1 / max(float(np.abs(self.slope).sum()), 1e-300))


@dataclass
class Fitted:
    """The models' coefficients (a column each, the intercept last), and how many scans of the rows they took."""

    specs: list[Spec]
    points: np.ndarray
    scans: int


def fit_many(rows: DataFrame, specs: Sequence[Spec], n_terms: int, iterations: int = 200, tolerance: float = 1e-8, start: np.ndarray | None = None) -> Fitted:
    """Fits all models to rows of `sparse_rows` with `fold`. start: points to begin at, such as those of another fit.

    tolerance: a model is done when no number of its gradient (of the mean loss) is larger. Without rows all is 0.
    """
    without = np.array([-1 if s.without is None else s.without for s in specs])
    points = np.zeros((n_terms + 1, len(specs))) if start is None else start.astype(float)
    models: list[_Descent] = []
    scans, held = 0, packed(rows).persist()
    while scans < iterations and not (models and all(m.done for m in models)):
        going = [k for k in range(len(specs)) if not models or not models[k].done]
        seen, loss, slope = scan(held, np.ascontiguousarray(points[:, going]), without[going])
        scans += 1
        seen = np.maximum(seen, 1)
        if not models:
            models = [_Descent(points[:, k].copy(), 1 / (s.c * seen[k])) for k, s in enumerate(specs)]
        for i, k in enumerate(going):
            models[k].told(float(loss[i] / seen[i]), slope[:, i] / seen[i], tolerance)
        points = np.stack([m.trial() for m in models], 1)
    held.unpersist()
    return Fitted(list(specs), np.stack([m.point for m in models], 1) if models else points, scans)


def log_losses(rows: DataFrame, points: np.ndarray, folds: np.ndarray | None = None) -> np.ndarray:
    """Each model's mean loss over all rows, or over those of its fold: one scan."""
    all_rows = folds is None
    seen, loss, _ = scan(packed(rows), points, np.full(points.shape[1], -1) if all_rows else folds, only=not all_rows, gradient=False)
    return loss / np.maximum(seen, 1)


def _shrunk(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Coefficients moved towards 0 by a number for each model; the intercept stays."""
    out = np.sign(points) * np.maximum(np.abs(points) - by, 0)
    out[-1] = points[-1]
    return out


def l1_violation(points: np.ndarray, slope: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """How far each model is from an optimum: the largest distance of 0 from the subgradient of mean loss + strength x |w|."""
    off = np.where(points != 0, np.abs(slope + strength * np.sign(points)), np.maximum(np.abs(slope) - strength, 0))
    off[-1] = np.abs(slope[-1])
    return off.max(0)


def fit_l1(rows: DataFrame, specs: Sequence[Spec], n_terms: int, iterations: int = 1000, tolerance: float = 1e-6) -> Fitted:
    """As `fit_many`, with |w| / (c n) in place of the squares: many coefficients are exactly 0.

    Proximal steps with momentum on the aggregated gradients of all models, one scan each. A step is shortened where it
    promises more than it holds, and the momentum starts again where it leads uphill.
    """
    without = np.array([-1 if s.without is None else s.without for s in specs])
    m, rows = len(specs), packed(rows).persist()
    at = ahead = np.zeros((n_terms + 1, m))
    speed, size = np.ones(m), np.full(m, 4.0)
    seen, loss, slope = scan(rows, ahead, without)
    scans, seen = 1, np.maximum(seen, 1)
    strength = 1 / (np.array([s.c for s in specs]) * seen)
    loss, slope = loss / seen, slope / seen
    done = l1_violation(at, slope, strength) <= tolerance
    while not done.all() and scans < iterations:
        new = np.where(done, at, _shrunk(ahead - size * slope, size * strength))
        new_loss, new_slope = (x / seen for x in scan(rows, new, without)[1:])
        scans += 1
        change = new - ahead
        short = ~done & (new_loss > loss + (slope * change).sum(0) + (change * change).sum(0) / (2 * size) + 1e-15)
        size = np.where(short, size / 2, size)
        ok = ~done & ~short
        done |= ok & (l1_violation(new, new_slope, strength) <= tolerance)
        uphill = ((ahead - new) * (new - at)).sum(0) > 0
        faster = np.where(uphill, 1.0, (1 + np.sqrt(1 + 4 * speed**2)) / 2)
        push = np.where(uphill, 0.0, (speed - 1) / faster)
        step = new + push * (new - at)
        at, speed = np.where(ok, new, at), np.where(ok, faster, speed)
        ahead = np.where(ok & ~done, step, np.where(ok, new, ahead))
        if (ok & ~done & (push != 0)).any():
            loss, slope = (x / seen for x in scan(rows, ahead, without)[1:])
            scans += 1
        else:
            loss, slope = np.where(ok, new_loss, loss), np.where(ok, new_slope, slope)
    rows.unpersist()
    return Fitted(list(specs), at, scans)
