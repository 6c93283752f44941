"""Trees grown level by level on Spark: extremely randomised forests, and LambdaMART ranking.

No row leaves its partition.  A level of all trees (or of all models' trees) is one aggregate of sums per (tree, node, feature, ...);
the driver sees these sums only, whose number is bounded by trees x nodes x features (x bins).  Sums are of integers (weights
and gradients in fixed point), so that a model does not depend on the order or the partitioning of the rows.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

FIXED = 1 << 20  # weights and gradients are counted in these units
PAIRS = 256  # rows of a group up to which its pairs are gone through one by one


def placed(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Node of each row (rows x features) in each tree: ``feature`` and ``threshold`` are trees x nodes, in heap order; -1 marks a leaf."""
    columns, rows = x.ravel("F"), np.arange(len(x))
    out = np.zeros((len(feature), len(x)), np.int64)
    for k, (f, cut) in enumerate(zip(feature, threshold)):  # a tree at a time: its nodes and one column of places stay in the cache
        inner, f, at = f >= 0, np.maximum(f, 0) * len(x), out[k]
        while (going := inner.take(at)).any():
            at = np.where(going, 2 * at + 1 + (columns.take(f.take(at) + rows) > cut.take(at)), at)
        out[k] = at
    return out.T


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    share: np.ndarray  # of class 1, for every node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.arange(len(self.feature))[None, :], placed(x, self.feature, self.threshold)].mean(1)


def drawn(seed: int, tree: int, node: int, d: int) -> np.ndarray:
    """A number in [0, 1) for each feature, fixed by seed, tree and node."""
    return np.random.default_rng((seed, tree, node)).random(2 * d)


def extra_trees(df: DataFrame, x: str, y: str, w: str, trees: int = 150, depth: int = 5, seed: int = 42, max_features: int | None = None) -> Forest:
    """Extremely randomised trees for a 0/1 target: in every node ``max_features`` features (the root of their number by default) that are
    not constant there, one uniform threshold each between the node's lowest and highest value, and the best of them by Gini.

    ``x``: array of finite doubles.  Every level costs two passes: extremes of the open nodes, then class weights beside the drawn thresholds.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y"), F.round(F.col(w) * FIXED).cast("long").alias("w")).where("w > 0")
    # rows of equal features and target are one row of their weight; few bytes, much work: every task gets its share of them
    rows = rows.groupBy("x", "y").agg(F.sum("w").alias("w"))
    rows = written(rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "x"), "forest")
    first = rows.first()
    size, d = 2 ** (depth + 1) - 1, len(first["x"]) if first else 0
    k = max_features or max(1, int(d ** 0.5))
    feature, threshold = np.full((trees, size), -1, np.int64), np.zeros((trees, size))
    sums = np.zeros((trees, size, 2), np.int64)
    if first is None:
        return Forest(feature, threshold, np.zeros((trees, size)))
    for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect():
        sums[:, 0, r["y"]] = r["w"]
    for level in range(depth):
        low, n = 2 ** level - 1, 2 ** level
        open_ = (sums[:, low:low + n] > 0).all(2)  # both classes
        if not open_.any():
            break

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
            """A tree at a time: all rows, and which of them are at which open cells."""
            for frame in frames:
                values, y_, w_ = np.asfortranarray(np.stack(frame["x"].to_numpy())), frame["y"].to_numpy(), frame["w"].to_numpy(float)
                for tree in np.flatnonzero(open_.any(1)):
                    at = placed(values, feature[tree:tree + 1], threshold[tree:tree + 1])[:, 0] - low
                    row = np.flatnonzero((at >= 0) & open_[tree, np.maximum(at, 0)])
                    if len(row):
                        yield values, row, tree * n + at[row], y_, w_

        def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lo, hi = np.full((trees * n, d), np.inf), np.full((trees * n, d), -np.inf)
            for values, row, cell, _, _ in each(frames):
                first = cell.min()
                order = np.argsort((cell - first).astype(np.int16), kind="stable")  # cells of one tree; a radix sort
                run, who = cell[order], row[order]
                start = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                cells = run[start]
                for f in range(d):
                    some = values[:, f].take(who)
                    lo[cells, f] = np.minimum(lo[cells, f], np.minimum.reduceat(some, start))
                    hi[cells, f] = np.maximum(hi[cells, f], np.maximum.reduceat(some, start))
            cell, f = np.nonzero(lo < np.inf)
            yield pd.DataFrame({"cell": cell, "f": f, "lo": lo[cell, f], "hi": hi[cell, f]})

        lo, hi = np.zeros((trees * n, d)), np.zeros((trees * n, d))
        for r in rows.mapInPandas(extremes, "cell long, f long, lo double, hi double").groupBy("cell", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            lo[r["cell"], r["f"]], hi[r["cell"], r["f"]] = r["lo"], r["hi"]
        cut, tried = np.zeros((trees * n, d)), np.zeros((trees * n, d), bool)
        for cell in np.flatnonzero(open_.ravel()):
            u = drawn(seed, int(cell // n), int(low + cell % n), d)
            usable = np.flatnonzero(lo[cell] < hi[cell])
            tried[cell, usable[np.argsort(u[d:][usable], kind="stable")][:k]] = True
            cut[cell] = np.where((at := lo[cell] + u[:d] * (hi[cell] - lo[cell])) < hi[cell], at, lo[cell])

        picked = np.argsort(~tried, 1, kind="stable")[:, :k]  # the features tried in a cell, first ones first

        def beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left = np.zeros((trees * n, d, 2), np.int64)
            for values, row, cell, y_, w_ in each(frames):
                first = cell[0] // n * n  # of the tree
                for j in range(k):
                    f = picked[cell, j]
                    here = np.flatnonzero(tried[cell, f] & (values[row, f] <= cut[cell, f]))
                    at = ((cell[here] - first) * d + f[here]) * 2 + y_[row[here]]
                    left[first:first + n] += np.bincount(at, w_[row[here]], n * d * 2).astype(np.int64).reshape(n, d, 2)  # whole numbers: exact
            cell, f = np.nonzero(left.sum(2))
            yield pd.DataFrame({"cell": cell, "f": f, "no": left[cell, f, 0], "yes": left[cell, f, 1]})

        left = np.zeros((trees * n, d, 2), np.int64)
        for r in rows.mapInPandas(beside, "cell long, f long, no long, yes long").groupBy("cell", "f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).collect():
            left[r["cell"], r["f"]] = r["no"], r["yes"]
        for cell in np.flatnonzero(open_.ravel() & tried.any(1)):
            tree, node = int(cell // n), int(low + cell % n)
            l = left[cell].astype(float)  # noqa: E741
            rest = sums[tree, node] - l
            with np.errstate(invalid="ignore", divide="ignore"):
                pure = (l ** 2).sum(1) / l.sum(1) + (rest ** 2).sum(1) / rest.sum(1)
            f = int(np.argmax(np.where(tried[cell] & np.isfinite(pure), pure, -1)))
            feature[tree, node], threshold[tree, node] = f, cut[cell, f]
            sums[tree, 2 * node + 1], sums[tree, 2 * node + 2] = left[cell, f], sums[tree, node] - left[cell, f]
    total = sums.sum(2)
    return Forest(feature, threshold, np.where(total > 0, sums[..., 1] / np.maximum(total, 1), 0.0))


@dataclass
class ForestModel:
    """A forest behind the preparation of its features; ``transform`` adds ``probability`` like a Spark classifier."""

    prepared: object
    forest: Forest

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        sent = df.sparkSession.sparkContext.broadcast(self.forest)  # trees x 2**(depth + 1) numbers

        def predict(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in frames:
                yield pd.Series(sent.value.predict(np.stack(x.to_numpy())))

        p = F.pandas_udf(predict, "double")(vector_to_array("features"))
        return self.prepared.transform(df).withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


def pair_gradients(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of a group's rows: for every pair of different grades the logistic loss of the order, times what
    swapping the two would change in NDCG (gain 2**grade - 1, ranks by score, ties in row order)."""
    if len(scores) > PAIRS:
        return summed_gradients(scores, grades)
    order = np.argsort(-scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    gain, discount = 2.0 ** grades - 1, 1 / np.log2(1 + rank)
    ideal = (np.sort(gain)[::-1] / np.log2(1 + np.arange(1, len(gain) + 1))).sum()
    if ideal <= 0:
        return np.zeros(len(scores)), np.zeros(len(scores))
    better = grades[:, None] > grades[None, :]
    change = np.abs(gain[:, None] - gain[None, :]) * np.abs(discount[:, None] - discount[None, :]) / ideal
    wrong = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    pull, curve = np.where(better, change * wrong, 0), np.where(better, change * wrong * (1 - wrong), 0)
    return pull.sum(0) - pull.sum(1), curve.sum(0) + curve.sum(1)


def summed_gradients(scores: np.ndarray, grades: np.ndarray, run: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The sums of :func:`pair_gradients` over all pairs, to double precision, without going through the pairs.

    In order of rank, the change of a pair is a difference of two discounts, so a row needs of each grade above and below it only the
    sums of K(s_i - s_j) and of discount_j K(s_i - s_j), where K(x) = 1 / (1 + exp(x)) or its slope.  K(s - t) is smooth in s: its values
    at Chebyshev nodes give it between them (the next pole is pi away from the real line, which sets their number).  So sums over all
    higher, and all lower, scores are kept at the nodes; only scores within a run of neighbours meet each other.
    """
    order = np.argsort(-scores, kind="stable")
    levels, grade = np.unique(grades[order], return_inverse=True)
    gain, n, kinds = 2.0 ** levels - 1, len(scores), len(levels)
    discount = 1 / np.log2(2 + np.arange(n))
    ideal = (np.sort(gain[grade])[::-1] * discount).sum()
    if ideal <= 0:
        return np.zeros(n), np.zeros(n)
    s, tie = np.unique(-scores[order], return_inverse=True)
    s = -s  # different scores, falling
    held = np.zeros((len(s), 2 * kinds))  # by score: rows of each grade, then their discounts
    np.add.at(held, (tie, grade), 1.0)
    np.add.at(held, (tie, kinds + grade), discount)

    half, middle = max((s[0] - s[-1]) / 2, 1e-9), (s[0] + s[-1]) / 2
    p = int(40 / np.arcsinh(np.pi / half)) + 8
    angle = np.pi * (np.arange(p) + 0.5) / p
    nodes = middle + half * np.cos(angle)
    to_nodes = np.cos(np.outer(np.arange(p), angle)) * np.where(np.arange(p) > 0, 2 / p, 1 / p)[:, None]

    def kernels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = 1 / (1 + np.exp(np.clip(a[:, None] - b[None, :], -50, 50)))
        return k, k * (1 - k)

    runs = [slice(a, a + run) for a in range(0, len(s), run)]
    parts = [[k @ held[r] for k in kernels(nodes, s[r])] for r in runs]
    above, below = np.zeros((2, p, 2 * kinds)), np.sum(parts, 0)
    sums = np.empty((2, 2, len(s), 2 * kinds))  # kernel, side (higher scores, lower scores)
    for r, part in zip(runs, parts):
        below -= part
        at = np.cos(np.outer(np.arccos(np.clip((s[r] - middle) / half, -1, 1)), np.arange(p))) @ to_nodes
        for z, k in enumerate(kernels(s[r], s[r])):
            sums[z, 0, r] = at @ above[z] + np.tril(k, -1) @ held[r]
            sums[z, 1, r] = at @ below[z] + np.triu(k, 1) @ held[r]
        above += part

    one = np.zeros((n, 2 * kinds))
    one[np.arange(n), grade], one[np.arange(n), kinds + grade] = 1.0, discount
    upto = np.cumsum(one, 0)
    before = np.concatenate([np.zeros((1, 2 * kinds)), np.cumsum(held, 0)])  # rows of higher scores
    own, own_all = upto - before[tie], held[tie]  # a row counts itself with a difference of 0
    d, rest = discount[:, None], upto[-1] - upto
    apart = lambda higher, lower: higher[:, kinds:] - d * higher[:, :kinds] + d * lower[:, :kinds] - lower[:, kinds:]
    equal = apart(own, own_all - own)
    wrong = apart(sums[0, 0][tie], sums[0, 1][tie]) + equal / 2
    curve = apart(sums[1, 0][tie], sums[1, 1][tie]) + equal / 4
    stake = np.abs(gain[grade][:, None] - gain[None, :]) / ideal
    worse = grade[:, None] < np.arange(kinds)[None, :]
    pull = (stake * np.where(worse, apart(upto, rest) - wrong, -wrong)).sum(1)
    g, h = np.empty(n), np.empty(n)
    g[order], h[order] = pull, (stake * curve).sum(1)
    return g, h


@dataclass
class Ranker:
    """Boosted trees over raw feature values: trees x nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.zeros(len(x))
        return self.value[np.arange(len(self.feature))[None, :], placed(x, self.feature, self.threshold)].sum(1)


def lambda_mart(
    df: DataFrame, model: str, group: str, ident: str, x: str, grade: str, weight: str, rounds: int = 40, step: float = 0.1, depth: int = 3, bins: int = 64,
    ridge: float = 1.0, least_curve: float = 1e-3,
) -> dict:
    """Rankers of all values of ``model``, grown side by side: one tree per model and round, one aggregate per level for all models.

    A row of the working table is a whole decision group: features as bin numbers, grades, running scores, some 40 bytes a ticker.
    Gradients are taken within it and weigh by the group's mean ``weight``; groups of one row are left out.  ``x``: array of finite doubles.
    """
    rows = df.select(F.col(model).alias("m"), F.col(group).alias("g"), F.col(ident).alias("i"), F.col(x).alias("x"), F.col(grade).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    first = rows.first()
    if first is None:
        return {}
    d = len(first["x"])
    probs = [k / bins for k in range(1, bins)]
    cuts = {r["m"]: [sorted(set(r[f"q{f}"])) for f in range(d)] for r in rows.groupBy("m").agg(*[F.percentile_approx(F.col("x")[f], probs, 10_000).alias(f"q{f}") for f in range(d)]).collect()}

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        values = np.stack(frame["x"].to_numpy())
        binned = np.stack([np.searchsorted(cuts[key[0]][f], values[:, f], "left") for f in range(d)], 1).astype(np.uint8)
        n = len(frame) if len(frame) > 1 else 0
        made = {"m": key[0], "bins": binned.tobytes(), "y": frame["y"].to_numpy(float).tobytes(), "w": float(frame["w"].mean()), "s": np.zeros(len(frame)).tobytes()}
        return pd.DataFrame([made] if n else [], columns=["m", "bins", "y", "w", "s"])

    kind = df.schema[model].dataType.simpleString()
    rows = rows.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "m", "g")  # few bytes, much work: else joined to few tasks
    state = written(rows.groupBy("m", "g").applyInPandas(pack, f"m {kind}, bins binary, y binary, w double, s binary"), "groups")
    models = sorted(cuts, key=str)
    size = 2 ** (depth + 1) - 1
    grown = {m: ([], [], []) for m in models}
    last = None
    for k in range(rounds):

        def renewed(frames: Iterator[pd.DataFrame], last=last) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for m, b, y, w, s in frame[["m", "bins", "y", "w", "s"]].itertuples(index=False):
                    scores = np.frombuffer(s).copy()
                    if last is not None:
                        at = placed(np.frombuffer(b, np.uint8).reshape(-1, d), last[m][0], last[m][1])
                        scores += last[m][2][0, at[:, 0]]
                    g, h = pair_gradients(scores, np.frombuffer(y))
                    out.append((m, b, y, w, scores.tobytes(), np.round(g * w * FIXED).astype(np.int64).tobytes(), np.round(h * w * FIXED).astype(np.int64).tobytes()))
                yield pd.DataFrame(out, columns=["m", "bins", "y", "w", "s", "g", "h"])

        now = state.select("m", "bins", "y", "w", "s").mapInPandas(renewed, f"m {kind}, bins binary, y binary, w double, s binary, g binary, h binary")
        before, state = state, written(now, "groups") if k % 10 == 9 else now.persist()
        tree = {m: (np.full((1, size), -1, np.int64), np.zeros((1, size)), np.zeros((1, size))) for m in models}
        for level in range(depth):
            low, n = 2 ** level - 1, 2 ** level

            def histogram(frames: Iterator[pd.DataFrame], tree=tree) -> Iterator[pd.DataFrame]:
                sums = {m: np.zeros((n, d, bins, 2), np.int64) for m in models}
                for frame in frames:
                    for m, b, g, h in frame[["m", "bins", "g", "h"]].itertuples(index=False):
                        values = np.frombuffer(b, np.uint8).reshape(-1, d)
                        at = placed(values, tree[m][0], tree[m][1])[:, 0] - low
                        here = np.flatnonzero(at >= 0)
                        for z, sent in enumerate((g, h)):
                            of = np.frombuffer(sent, np.int64)[here].astype(float)  # whole numbers: their sums stay exact
                            for f in range(d):
                                sums[m][:, f, :, z] += np.bincount(at[here] * bins + values[here, f], of, n * bins).reshape(n, bins).astype(np.int64)
                for m, s in sums.items():
                    node, f, b = np.nonzero(s.any(3))
                    yield pd.DataFrame({"m": m, "node": node, "f": f, "b": b, "g": s[node, f, b, 0], "h": s[node, f, b, 1]})

            got = {m: np.zeros((n, d, bins, 2), np.int64) for m in models}
            for r in state.select("m", "bins", "g", "h").mapInPandas(histogram, f"m {kind}, node long, f long, b long, g long, h long").groupBy("m", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                got[r["m"]][r["node"], r["f"], r["b"]] = r["g"], r["h"]
            for m in models:
                _grow(tree[m], got[m] / FIXED, low, n, cuts[m], step, ridge, least_curve)
        if k % 10 == 9 or before.storageLevel.useMemory:
            before.unpersist()
        for m in models:
            feature, threshold, value = tree[m]
            raw = np.array([[cuts[m][f][int(t)] if f >= 0 else 0.0 for f, t in zip(feature[0], threshold[0])]])
            for part, made in zip(grown[m], (feature, raw, value)):
                part.append(made)
        last = tree
    state.unpersist()
    return {m: Ranker(*[np.concatenate(p) for p in parts]) for m, parts in grown.items()}


def _grow(tree: tuple, sums: np.ndarray, low: int, n: int, cuts: Sequence, step: float, ridge: float, least_curve: float) -> None:
    """Splits the nodes of a level where that lowers the loss; children get their values, thresholds are bin numbers."""
    feature, threshold, value = tree
    for node in range(n):
        total = sums[node, 0].sum(0)
        if low == 0:
            value[0, 0] = -step * total[0] / (total[1] + ridge)
        if total[1] <= 0:
            continue
        best = (1e-12, -1, 0, None)
        for f in range(sums.shape[1]):
            left = np.cumsum(sums[node, f], 0)[:len(cuts[f])]
            right = total - left
            gain = left[:, 0] ** 2 / (left[:, 1] + ridge) + right[:, 0] ** 2 / (right[:, 1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain = np.where((left[:, 1] >= least_curve) & (right[:, 1] >= least_curve), gain, -1.0)
            if len(gain) and gain.max() > best[0]:
                b = int(gain.argmax())
                best = (gain[b], f, b, left[b])
        if best[1] >= 0:
            at = low + node
            feature[0, at], threshold[0, at] = best[1], best[2]
            for child, (g, h) in ((2 * at + 1, best[3]), (2 * at + 2, total - best[3])):
                value[0, child] = -step * g / (h + ridge)
