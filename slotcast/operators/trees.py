"""Boosted trees and forests for many models at once, over rows binned to bytes.

A table holds rows of several keys (say, repeats of a split); each key has the same list of models, which differ in target, columns
and parameters. Gradients are whole numbers of a size that lets any sum stay exact in a double, so the trees do not depend on
how rows are spread over tasks or in which order they are added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.session import materialise, release, ship_code

#: Rows and bytes of bins of a key up to which one task fits the key's models; beyond, every level of a tree is a job over all rows.
KEY_ROWS = 100_000
KEY_BYTES = 64 << 20
#: Boosting rounds after which rows are stored again with their predictions.
STORE_EVERY = 10
MAX_BINS = 255


@dataclass(frozen=True)
class TreeModel:
    """One model of a key: a column of targets, the columns it may split, and parameters.

    ``penalty`` is added to the rows of a node wherever a sum is divided by them. Boosting starts from the mean target. With ``bagging`` trees are not
    added up but averaged: each is grown on hashed Poisson counts of the rows and draws ``columns_drawn`` columns for each node.
    """

    target: int
    columns: tuple[int, ...]
    rounds: int = 300
    step: float = 0.01
    min_rows: int = 5
    subsample: float = 1.0
    depth: int = 15
    seed: int = 1
    penalty: float = 1.0
    bagging: bool = False
    columns_drawn: int | None = None


@dataclass
class Tree:
    """Nodes in the order of their making; the children of node k are ``child[k]`` (bin up to the cut) and the next one."""

    column: list[int]
    cut: list[int]
    child: list[int]
    rows: list[float]
    total: list[float]

    @staticmethod
    def root() -> Tree:
        return Tree([-1], [0], [-1], [0.0], [0.0])

    def split(self, node: int, column: int, cut: int, rows: float, total: float) -> None:
        """Turn a leaf into a split whose left side has ``rows`` rows with the sum ``total``."""
        self.column[node], self.cut[node], self.child[node] = column, cut, len(self.column)
        for n, s in ((rows, total), (self.rows[node] - rows, self.total[node] - total)):
            self.column.append(-1)
            self.cut.append(0)
            self.child.append(-1)
            self.rows.append(n)
            self.total.append(s)

    def divide(self, node: int, found: tuple[int, int, float, float], min_rows: int) -> list[int]:
        """Split a leaf; its children that have rows enough to be split again."""
        self.split(node, *found)
        first = self.child[node]
        return [c for c in (first, first + 1) if self.rows[c] >= 2 * max(min_rows, 1)]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        column, cut, child = (np.array(v) for v in (self.column, self.cut, self.child))
        node, here = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(here):
            at = node[here]
            here = here[column[at] >= 0]
            at = node[here]
            node[here] = child[at] + (bins[here, column[at]] > cut[at])
        return node

    def values(self, scale: float, penalty: float) -> np.ndarray:
        n = np.array(self.rows) + penalty
        return np.divide(np.array(self.total), n * scale, out=np.zeros(len(n)), where=n > 0)


def mixed(*numbers: np.ndarray | int) -> np.ndarray:
    """64 well-mixed bits of whole numbers."""
    h = np.zeros(1, dtype=np.uint64)
    for x in numbers:
        h = h + np.asarray(x, dtype=np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def uniform(*numbers: np.ndarray | int) -> np.ndarray:
    """Between 0 and 1, from the upper 53 bits."""
    return (mixed(*numbers) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def weights(model: TreeModel, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row counts in a tree: Poisson(1) by hash in a bag, else 1 or 0 by the sampled share."""
    if model.bagging:
        edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        return np.searchsorted(edges, uniform(model.seed, tree, rows), side="right").astype(np.float64)
    if model.subsample >= 1:
        return np.ones(len(rows))
    return (uniform(model.seed, tree, rows) < model.subsample).astype(np.float64)


def drawn(model: TreeModel, tree: int, node: np.ndarray, columns: int) -> np.ndarray:
    """Which of the columns a node may split, as (node, column): all, or the lowest hashes."""
    if model.columns_drawn is None or model.columns_drawn >= columns:
        return np.ones((len(node), columns), dtype=bool)
    h = np.stack([mixed(model.seed, tree, k, np.arange(columns)) for k in node.tolist()]) if len(node) else np.zeros((0, columns), np.uint64)
    return h <= np.sort(h, axis=1)[:, model.columns_drawn - 1 : model.columns_drawn]


def gains(n_left: np.ndarray, s_left: np.ndarray, n: np.ndarray, s: np.ndarray, model: TreeModel) -> np.ndarray:
    """What a split lowers the squares by, -inf where a side has too few rows or nothing is gained."""
    n_right, s_right = n - n_left, s - s_left
    good = (n_left >= model.min_rows) & (n_right >= model.min_rows) & (n_left > 0) & (n_right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = s_left * s_left / (n_left + model.penalty) + s_right * s_right / (n_right + model.penalty)
        gain = parts - s * s / (n + model.penalty)
    return np.where(good & (gain > 1e-12 * parts), gain, -np.inf)


class Sorted:
    """The rows of one model in the order of each column's bins."""

    def __init__(self, bins: np.ndarray) -> None:
        self.order = np.argsort(bins, axis=0, kind="stable").T
        self.bins = np.take_along_axis(bins.T, self.order, axis=1)

    def best(self, slot: np.ndarray, slots: int, n: np.ndarray, s: np.ndarray, allowed: np.ndarray, model: TreeModel) -> list[tuple[int, int, float, float] | None]:
        """For each slot of rows its best split ``(column, cut, rows, total)``: of equal ones that of the lowest column, then bin."""
        slot = slot.astype(np.int16 if slots < 1 << 15 else np.int64)  # short numbers are sorted by digits
        at = slot[self.order]
        out = int((slot < 0).sum())
        again = np.argsort(at, axis=1, kind="stable")[:, out:]
        rows, bins = np.take_along_axis(self.order, again, axis=1), np.take_along_axis(self.bins, again, axis=1)
        seg = np.sort(slot)[out:]
        start = np.searchsorted(seg, np.arange(slots))
        ends = np.append(start[1:], len(seg)) - 1
        cn, cs = np.cumsum(n[rows], axis=1), np.cumsum(s[rows], axis=1)
        zero = np.zeros((len(cn), 1))
        base_n, base_s = np.hstack([zero, cn])[:, start], np.hstack([zero, cs])[:, start]
        left_n, left_s = cn - base_n[:, seg], cs - base_s[:, seg]
        total_n, total_s = (cn[:, ends] - base_n)[:, seg], (cs[:, ends] - base_s)[:, seg]
        edge = np.zeros(bins.shape, dtype=bool)
        edge[:, :-1] = (bins[:, 1:] > bins[:, :-1]) & (seg[1:] == seg[:-1])
        gain = np.where(edge & allowed.T[:, seg], gains(left_n, left_s, total_n, total_s, model), -np.inf)
        top = np.maximum.reduceat(gain, start, axis=1)
        column = top.argmax(axis=0)
        found: list[tuple[int, int, float, float] | None] = []
        for k in range(slots):
            c = int(column[k])
            if top[c, k] == -np.inf:
                found.append(None)
                continue
            p = int(start[k]) + int(gain[c, start[k] : ends[k] + 1].argmax())
            found.append((c, int(bins[c, p]), float(left_n[c, p]), float(left_s[c, p])))
        return found


def scale_of(rows: int, largest: float) -> float:
    """The power of two that gradients are multiplied with before they are rounded: sums over all rows stay below 2^53."""
    bits = min(40, 50 - max(1, rows).bit_length())
    return 2.0 ** (bits - math.frexp(largest)[1]) if 0 < largest < math.inf else 1.0


def fit_rows(bins: np.ndarray, train: np.ndarray, y: np.ndarray, rows: np.ndarray, model: TreeModel) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of one model for all its rows, and those of a forest's rows by the trees whose bag they were not in (else NaN)."""
    b = bins[:, list(model.columns)]
    used = np.flatnonzero(train & np.isfinite(y))
    if not len(used):
        return np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    target = y[used]
    scale = scale_of(len(used), float(np.abs(target).max()))
    start = float(np.rint(target * scale).sum()) / scale / len(used)
    f = np.zeros(len(rows)) if model.bagging else np.full(len(rows), start)
    out, outs = np.zeros(len(rows)), np.zeros(len(rows))
    learned = b[used]
    ranked = Sorted(learned)
    for k in range(model.rounds):
        w = weights(model, k, rows[used])
        q = w * np.rint((target if model.bagging else target - f[used]) * scale)
        tree = Tree.root()
        tree.rows[0], tree.total[0] = float(w.sum()), float(q.sum())

        node = np.where(w > 0, 0, -1)
        open_ = [0]
        for _ in range(model.depth):
            slot = np.full(len(tree.column) + 1, -1)
            slot[open_] = np.arange(len(open_))
            kept = slot[node]
            some = np.unique(kept[kept >= 0])  # a node without counted rows has no split
            if not len(some):
                break
            dense = np.full(len(open_) + 1, -1)
            dense[some] = np.arange(len(some))
            nodes = np.array(open_)[some]
            best = ranked.best(dense[kept], len(some), w, q, drawn(model, k, nodes, b.shape[1]), model)
            open_ = []
            for at, found in zip(nodes.tolist(), best):
                if found is not None:
                    open_ += tree.divide(at, found, model.min_rows)
            column, cut, child = (np.array([*v, -1]) for v in (tree.column, tree.cut, tree.child))
            moved = np.flatnonzero(column[node] >= 0)
            here = node[moved]
            node[moved] = child[here] + (learned[moved, column[here]] > cut[here])
        value = tree.values(scale, model.penalty)[tree.place(b)]
        if model.bagging:
            f += value / model.rounds
            missed = np.zeros(len(rows), dtype=bool)
            missed[used] = w == 0
            out += np.where(missed, value, 0)
            outs += missed
        else:
            f += model.step * value
    return f, np.divide(out, outs, out=np.full(len(rows), np.nan), where=outs > 0)


_OUT = "key string, row bigint, train boolean, hat array<double>, out array<double>, extra array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([[math.nan if v is None else v for v in r] for r in column.to_pylist()], dtype=np.float64).reshape(len(column), -1)


def _key_fitter(models: list[TreeModel], chunks: int) -> Callable[[pa.Table], pa.Table]:
    def fit(rows: pa.Table) -> pa.Table:
        bins, y = _matrix(rows.column("bins")), _doubles(rows.column("y"))
        train, row = rows.column("train").to_numpy(), rows.column("row").to_numpy()
        # in the order of their numbers, so that nothing depends on how rows arrive
        order = np.argsort(row, kind="stable")
        back = np.argsort(order, kind="stable")
        found = [fit_rows(bins[order], train[order], y[order, m.target], row[order], m) for m in models[rows.column("chunk")[0].as_py() :: chunks]]
        lists = [pa.array(np.stack([f[k] for f in found], axis=1)[back].tolist(), pa.list_(pa.float64())) for k in (0, 1)]
        return pa.table([rows.column("chunk"), rows.column("key"), rows.column("row"), rows.column("train"), *lists, rows.column("extra")], ["chunk", "key", "row", "train", "hat", "out", "extra"])

    return fit


def fit_models(rows: DataFrame, models: list[TreeModel], key_rows: int = KEY_ROWS) -> DataFrame:
    """Fit all models of every key and predict all rows: ``(key, row, train, hat, out, extra)``.

    ``rows`` is a stored table of ``key`` (text), ``row`` (a number that no other row of the key has), ``train`` (whether a model may learn from the row), ``bins`` (a byte
    for each column), ``y`` (an array of targets; NULL and NaN ones are not learned from) and ``extra`` (an array that is handed on). ``hat`` has a prediction for each model,
    ``out`` for forests those by trees that did not see the row.

    If all keys are small, by a count of their rows, a task takes a key at a time. Else each level of all trees is one job: rows stay where they are,
    sums by model, node, column and bin are combined before the shuffle, and splits are picked where these sums meet. Both ways give the same trees.
    """
    ship_code(rows.sparkSession)
    largest = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("bins")).alias("width")).agg(F.max("n").alias("n"), F.max("width").alias("width"), F.count("*").alias("keys")).first()
    if largest["n"] is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    if largest["n"] <= key_rows and largest["n"] * largest["width"] <= KEY_BYTES:
        return _fit_by_keys(rows, models, largest["keys"])
    return _fit_by_levels(rows, models)


def bag_counts(rows: DataFrame, row: str, model: TreeModel) -> DataFrame:
    """``(row, tree, times)``: how often each tree's bag holds each row, the rows not in it with 0. It depends on seed, tree and row alone."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for t in range(model.rounds):
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(row), t, np.int32)), pa.array(weights(model, t, row).astype(np.int32))], ["row", "tree", "times"])

    ship_code(rows.sparkSession)
    return rows.select(F.col(f"`{row}`").cast("bigint").alias("row")).where("row is not null").mapInArrow(step, "row bigint, tree int, times int")


#: Tasks wanted for the fits of small keys; few keys are worked off by several tasks, each with some of the models.
KEY_TASKS = 64


def _fit_by_keys(rows: DataFrame, models: list[TreeModel], keys: int) -> DataFrame:
    chunks = min(len(models), max(1, KEY_TASKS // keys))
    dealt = rows.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in range(chunks)])))
    # a number of partitions of its own, because fits take long for the few bytes that they read
    found = dealt.repartition(min(2 * keys * chunks, 4096), "key", "chunk").groupBy("key", "chunk").applyInArrow(_key_fitter(models, chunks), f"chunk int, {_OUT}")
    if chunks == 1:
        return found.drop("chunk")
    parts = found.groupBy("key", "row").agg(F.first("train").alias("train"), F.array_sort(F.collect_list(F.struct("chunk", "hat", "out"))).alias("parts"), F.first("extra").alias("extra"))
    whole = [F.array(*[F.col("parts")[m % chunks][c][m // chunks] for m in range(len(models))]).alias(c) for c in ("hat", "out")]
    return parts.select("key", "row", "train", *whole, "extra")


@dataclass(frozen=True)
class _Fit:
    """What a job over all rows needs: scales and starts of (key, model), finished trees not yet in the stored predictions, and the growing ones."""

    models: list[TreeModel]
    scale: dict[tuple[str, int], float]
    done: list[dict[tuple[str, int], Tree]]
    now: dict[tuple[str, int], Tree]
    tree: int


def _by_key(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    keys = np.array(batch.column("key").to_pylist(), dtype=object)
    for key in dict.fromkeys(keys.tolist()):
        yield key, np.flatnonzero(keys == key)


def _current(fit: _Fit, key: str, k: int, bins: np.ndarray, f: np.ndarray, row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictions, sums and counts of unseen trees of a key's rows after the finished trees."""
    model = fit.models[k]
    f, out, outs = f.copy(), np.zeros(len(f)), np.zeros(len(f))
    first = fit.tree - len(fit.done)
    for t, trees in enumerate(fit.done):
        if (key, k) not in trees:
            continue
        tree = trees[key, k]
        value = tree.values(fit.scale[key, k], model.penalty)[tree.place(bins)]
        if model.bagging:
            f += value / model.rounds
            missed = known & (weights(model, first + t, row) == 0)
            out += np.where(missed, value, 0)
            outs += missed
        else:
            f += model.step * value
    return f, out, outs


def _histogrammer(fit: _Fit, open_: dict[tuple[str, int], list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            bins, y, f = _matrix(batch.column("bins")), _doubles(batch.column("y")), _doubles(batch.column("f"))
            train, row = batch.column("train").to_numpy(zero_copy_only=False), batch.column("row").to_numpy()
            for key, at in _by_key(batch):
                for k, model in enumerate(fit.models):
                    if (key, k) not in open_:
                        continue
                    target = y[at, model.target]
                    use = at[train[at] & np.isfinite(target)]
                    b = bins[use][:, list(model.columns)]
                    now = _current(fit, key, k, b, f[use, k], row[use], np.ones(len(use), bool))[0] if not model.bagging else 0.0
                    w = weights(model, fit.tree, row[use])
                    q = w * np.rint((y[use, model.target] - now) * fit.scale[key, k])
                    tree = fit.now[key, k]
                    nodes = np.array(open_[key, k])
                    slot = np.full(len(tree.column), -1)
                    slot[nodes] = nodes
                    node = slot[tree.place(b)]
                    good = (node >= 0) & (w > 0)
                    width = b.shape[1]
                    code = ((node[good, None] * width + np.arange(width)) * 256 + b[good]).ravel()
                    merged = held.get((key, k), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
                    codes, inverse = np.unique(np.concatenate([merged[0], code]), return_inverse=True)
                    sums = [np.bincount(inverse, weights=np.concatenate([m, np.repeat(v[good], width)]), minlength=len(codes)) for m, v in ((merged[1], w), (merged[2], q))]
                    held[key, k] = (codes, *sums)
        for (key, k), (codes, n, s) in held.items():
            width = len(fit.models[k].columns)
            node, rest = np.divmod(codes, width * 256)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(codes), pa.string()), pa.array(np.full(len(codes), k, np.int32)), pa.array(node), pa.array((rest // 256).astype(np.int32)), pa.array((rest % 256).astype(np.int32)), pa.array(n), pa.array(s)],
                ["key", "model", "node", "column", "bin", "n", "s"],
            )

    return step


def _picker(models: list[TreeModel], tree: int) -> Callable[[pa.Table], pa.Table]:
    """The best split of one node from its sums by column and bin."""
    def pick(sums: pa.Table) -> pa.Table:
        key, k, node = (sums.column(c)[0].as_py() for c in ("key", "model", "node"))
        model = models[k]
        column, bin_, n, s = (sums.column(c).to_numpy() for c in ("column", "bin", "n", "s"))
        order = np.lexsort([bin_, column])
        column, bin_, n, s = column[order], bin_[order], n[order], s[order]
        first = np.searchsorted(column, np.arange(len(model.columns)))
        end = np.append(first[1:], len(column)) - 1
        cn, cs = np.cumsum(n), np.cumsum(s)
        # sums of whole numbers below 2^53 are exact, so differences of running sums are too
        base_n, base_s = np.append(0, cn)[first][column], np.append(0, cs)[first][column]
        total_n, total_s = float(cn[end[0]]), float(cs[end[0]])
        allowed = drawn(model, tree, np.array([node]), len(model.columns))[0]
        edge = np.ones(len(column), dtype=bool)
        edge[end] = False
        gain = np.where(edge & allowed[column], gains(cn - base_n, cs - base_s, np.float64(total_n), np.float64(total_s), model), -np.inf)
        p = int(gain.argmax())
        split = gain[p] > -np.inf
        values = [key, k, node, int(column[p]) if split else -1, int(bin_[p]), float(cn[p] - base_n[p]), float(cs[p] - base_s[p]), total_n, total_s]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        names = ["key", "model", "node", "column", "cut", "rows", "total", "all_rows", "all_total"]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names)

    return pick


def _advancer(fit: _Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the finished trees taken into their predictions."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, f, y = _matrix(batch.column("bins")), _doubles(batch.column("f")), _doubles(batch.column("y"))
            out, outs = _doubles(batch.column("out")), _doubles(batch.column("outs"))
            train, row = batch.column("train").to_numpy(zero_copy_only=False), batch.column("row").to_numpy()
            for key, at in _by_key(batch):
                for k, model in enumerate(fit.models):
                    known = train[at] & np.isfinite(y[at, model.target])
                    f[at, k], more, times = _current(fit, key, k, bins[at][:, list(model.columns)], f[at, k], row[at], known)
                    out[at, k] += more
                    outs[at, k] += times
            new = {"f": f, "out": out, "outs": outs}
            yield pa.RecordBatch.from_arrays([pa.array(new[c].tolist(), pa.list_(pa.float64())) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return step


def _fit_by_levels(rows: DataFrame, models: list[TreeModel]) -> DataFrame:
    targets = sorted({m.target for m in models})
    y = {t: F.nanvl(F.col("y")[t], F.lit(None).cast("double")) for t in targets}
    size = rows.groupBy("key").agg(*[F.count(F.when(F.col("train"), y[t])).alias(f"n{t}") for t in targets], *[F.max(F.when(F.col("train"), F.abs(y[t]))).alias(f"m{t}") for t in targets])
    # a row for each key: keys and models are as many as the caller named
    known = {r["key"]: r for r in size.collect()}
    by_target = {(key, t): scale_of(r[f"n{t}"], r[f"m{t}"]) for key, r in known.items() for t in targets if r[f"n{t}"]}
    scale = {(key, k): by_target[key, m.target] for key in known for k, m in enumerate(models) if (key, m.target) in by_target}
    scales = rows.sparkSession.createDataFrame([(key, [by_target.get((key, t), 1.0) for t in targets]) for key in known], "key string, scale array<double>")
    whole = rows.join(F.broadcast(scales), "key").groupBy("key").agg(*[F.sum(F.when(F.col("train"), F.rint(y[t] * F.col("scale")[i]))).alias(f"s{t}") for i, t in enumerate(targets)])
    start = {(r["key"], t): r[f"s{t}"] / by_target[r["key"], t] / known[r["key"]][f"n{t}"] for r in whole.collect() for t in targets if (r["key"], t) in by_target}
    first = rows.sparkSession.createDataFrame(
        [(key, [math.nan if (key, m.target) not in start else 0.0 if m.bagging else start[key, m.target] for m in models], [0.0] * len(models)) for key in known], "key string, f array<double>, out array<double>"
    )
    state = materialise(rows.join(F.broadcast(first), "key").withColumn("outs", F.col("out")))
    fit = _Fit(models, scale, [], {}, 0)
    for t in range(max(m.rounds for m in models)):
        live = [kk for kk in scale if models[kk[1]].rounds > t]
        fit = replace(fit, now={kk: Tree.root() for kk in live}, tree=t)
        open_ = {kk: [0] for kk in live}
        for level in range(max(models[k].depth for _, k in live) if live else 0):
            open_ = {kk: nodes for kk, nodes in open_.items() if nodes and level < models[kk[1]].depth}
            if not open_:
                break
            sums = state.mapInArrow(_histogrammer(fit, open_), "key string, model int, node bigint, column int, bin int, n double, s double")
            added = sums.groupBy("key", "model", "node", "column", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            best = added.groupBy("key", "model", "node").applyInArrow(
                _picker(models, t), "key string, model int, node bigint, column int, cut int, rows double, total double, all_rows double, all_total double"
            )
            found: dict[tuple[str, int], dict[int, tuple]] = {}
            for r in best.collect():  # a row for each open node
                found.setdefault((r["key"], r["model"]), {})[r["node"]] = r
            grown = {}
            for kk, nodes in open_.items():
                tree, grown[kk] = fit.now[kk], []
                for node in nodes:
                    r = found.get(kk, {}).get(node)
                    if r is None:
                        continue
                    tree.rows[node], tree.total[node] = r["all_rows"], r["all_total"]
                    if r["column"] >= 0:
                        grown[kk] += tree.divide(node, (r["column"], r["cut"], r["rows"], r["total"]), models[kk[1]].min_rows)
            open_ = grown
        fit = replace(fit, done=[*fit.done, fit.now], now={}, tree=t + 1)
        if len(fit.done) == STORE_EVERY:
            after = materialise(state.mapInArrow(_advancer(fit), state.schema))
            release(state)
            state, fit = after, replace(fit, done=[])
    last = state.mapInArrow(_advancer(fit), state.schema) if fit.done else state
    unseen = F.transform(F.arrays_zip("out", "outs"), lambda z: F.when(z["outs"] > 0, z["out"] / z["outs"]).otherwise(F.lit(float("nan"))))
    return last.select("key", "row", "train", F.col("f").alias("hat"), unseen.alias("out"), "extra")


def bin_edges(rows: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> dict[str, list[np.ndarray]]:
    """For each key the cuts between the bins of each column: midways between its training values, or between so many quantiles if it has more.

    Keys, columns and bins bound what reaches the driver.
    """
    if not 2 <= max_bins <= MAX_BINS:
        raise ValueError(f"max_bins is between 2 and {MAX_BINS}")
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins + 1)])
    wanted = rows.where("train").groupBy("key").agg(*[F.array_distinct(F.percentile_approx(F.col(f"`{c}`"), shares, 10_000)).alias(f"e{k}") for k, c in enumerate(columns)])
    out = {}
    for r in wanted.collect():
        levels = [np.unique(np.array(r[f"e{k}"] or [], dtype=float)) for k in range(len(columns))]
        out[r["key"]] = [(v[1:] + v[:-1]) / 2 for v in levels]
    return out


def binned(rows: DataFrame, columns: list[str], edges: dict[str, list[np.ndarray]]) -> DataFrame:
    """``rows`` (``key``, ``row``, ``train``, ``y``, ``extra`` and the columns) with ``bins`` in place of the columns. Keys without training rows have one bin."""
    spark = ship_code(rows.sparkSession)
    shared = spark.sparkContext.broadcast(edges)
    names = ["key", "row", "train", "y", "extra"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], axis=1)
            out = np.zeros(x.shape, dtype=np.uint8)
            for key, at in _by_key(batch):
                for k, cuts in enumerate(shared.value.get(key, [])):
                    out[at, k] = np.searchsorted(cuts, x[at, k], side="left")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([r.tobytes() for r in out], pa.binary())], [*names, "bins"])

    picked = rows.select(*names, *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    return picked.mapInArrow(step, "key string, row bigint, train boolean, y array<double>, extra array<double>, bins binary")
