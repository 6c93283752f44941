"""Gradient-boosted classifiers over few features, several models side by side.

The trees of such a model see a row by its bins only, so rows of equal bins and target have equal margins and gradients in every
round.  They are summed once, on Spark; a model is then grown on at most 2 * bins ** features sums, whatever the number of rows,
and is a table of margins by bins.  Wider models are Spark ML's (see models.estimator).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 20  # most cells of a model


def fits(features: Sequence[str], bins: int = 32) -> bool:
    return bins ** len(features) <= CELLS


def margins(no: np.ndarray, yes: np.ndarray, shape: Sequence[int], rounds: int, step: float, depth: int) -> np.ndarray:
    """Margins (half the log odds) of all cells of a grid, from the weights of class 0 and 1 in each, both flat.

    A regression tree on the labels -1 and 1, then ``rounds`` - 1 trees on the gradients of 2 log(1 + exp(-2 y F)), each times ``step``;
    leaves are weighted means, splits lower the squared error most (of equal ones: first feature, lowest bin).
    """
    place = np.stack(np.unravel_index(np.arange(no.size), shape), 1)
    weight, used = no + yes, np.flatnonzero(no + yes)
    base = np.concatenate([[0], np.cumsum(shape)[:-1]])  # bins of all features side by side
    slots, w = int(sum(shape)), weight[used]
    out = np.zeros(no.size)
    for k in range(rounds):
        up, down = (np.ones(len(used)),) * 2 if k == 0 else (4 / (1 + np.exp(2 * out[used])), 4 / (1 + np.exp(-2 * out[used])))
        g = yes[used] * up - no[used] * down  # weighted sum of each cell's targets
        node, leaf = np.zeros(no.size, np.int64), np.zeros(1)
        leaf[0] = g.sum() / w.sum() if len(used) else 0.0
        for level in range(depth + 1):
            n = 2 ** level
            here = node[used]
            total = np.stack([np.bincount(here, v, n) for v in (g, w)])
            leaf = np.where(total[1] > 0, total[0] / np.where(total[1] > 0, total[1], 1), leaf)
            if level == depth:
                break
            at = here[:, None] * slots + base + place[used]
            sums = [np.bincount(at.ravel(), np.repeat(v, len(shape)), n * slots).reshape(n, slots) for v in (g, w)]
            gain = np.full((n, slots), -1.0)  # of the rows up to a bin against the others
            for f, size in enumerate(shape):
                left = [np.cumsum(s[:, base[f]:base[f] + size], 1)[:, :-1] for s in sums]
                right = [t[:, None] - l for t, l in zip(total, left)]  # noqa: E741
                both = (left[1] > 0) & (right[1] > 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    better = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - (total[0] ** 2 / total[1])[:, None]
                gain[:, base[f]:base[f] + size - 1] = np.where(both, better, -1.0)
            best = gain.argmax(1)
            split = gain[np.arange(n), best] > 1e-9 * np.maximum(total[1], 1e-300)
            feature = np.searchsorted(base, best, "right") - 1
            right = split[node] & (place[np.arange(no.size), feature[node]] > (best - base[feature])[node])
            node, leaf = 2 * node + right, np.repeat(leaf, 2)
        out += (1.0 if k == 0 else step) * leaf[node]
    return out


class Boosted:
    """Models by name: medians for missing values, the upper edges of the bins and the margins of all cells."""

    def __init__(self, medians: dict, cuts: dict, table: dict):
        self.medians, self.cuts, self.table = medians, cuts, table

    def cells(self, model, values: np.ndarray) -> np.ndarray:
        """Cell of each row (rows x features) of one model; a missing value is the median."""
        cuts = self.cuts[model]
        filled = np.where(np.isnan(values), self.medians[model], values)
        binned = [np.searchsorted(c, filled[:, f], "left") for f, c in enumerate(cuts)]
        return np.ravel_multi_index(binned, [len(c) + 1 for c in cuts]) if len(values) else np.empty(0, np.int64)

    def predict(self, model, values: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-2 * self.table[model][self.cells(model, values)]))


def boosted(df: DataFrame, model: str, features: Sequence[str], y: str, w: str | None, rounds: int = 150, step: float = 0.05, depth: int = 5, bins: int = 32) -> Boosted:
    """Models of all values of ``model``.  Weights are balanced by the two classes of a model's own rows; a feature has at most ``bins``
    bins, cut at quantiles of its values; a missing one (null or NaN) is its median among the model's rows."""
    rows = df.select(F.col(model).alias("m"), *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)],
                     F.col(y).cast("int").alias("y"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w")).where("y IS NOT NULL")
    d, kind = len(features), df.schema[model].dataType.simpleString()
    middle = {r["m"]: np.array([r[f"x{i}"] or 0.0 for i in range(d)]) for r in rows.groupBy("m").agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"x{i}") for i in range(d)]).collect()}
    if not middle:
        return Boosted({}, {}, {})
    fill = [F.create_map(*[F.lit(v) for m, x in middle.items() for v in (m, float(x[i]))]) for i in range(d)]
    rows = rows.withColumns({f"x{i}": F.coalesce(f"x{i}", fill[i][F.col("m")]) for i in range(d)})
    probs = [k / bins for k in range(1, bins)]
    cuts = {r["m"]: [np.unique(r[f"x{i}"]) for i in range(d)] for r in rows.groupBy("m").agg(*[F.percentile_approx(f"x{i}", probs, 10_000).alias(f"x{i}") for i in range(d)]).collect()}
    made = Boosted(middle, cuts, {})
    cell = cell_of(made, F.col("m"), [F.col(f"x{i}") for i in range(d)])
    sums = rows.withColumn("cell", cell).groupBy("m", "cell", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shape = [len(c) + 1 for c in cuts[key[0]]]
        part = [frame[frame["y"] == c] for c in (0, 1)]
        by_class = [np.zeros(int(np.prod(shape))) for _ in part]
        for flat, p in zip(by_class, part):
            flat[p["cell"].to_numpy()] = p["w"].to_numpy() * frame["n"].sum() / (2.0 * p["n"].sum())
        return pd.DataFrame({"m": [key[0]], "table": [margins(*by_class, shape, rounds, step, depth).tobytes()]})

    for r in sums.groupBy("m").applyInPandas(grow, f"m {kind}, table binary").collect():
        made.table[r["m"]] = np.frombuffer(r["table"])
    return made


def cell_of(made: Boosted, model: Column, values: Sequence[Column]) -> Column:
    def place(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for m, *x in frames:
            yield _by_model(m, x, made.cells, np.int64)

    return F.pandas_udf(place, "long")(model, *values)


def probability(spark, made: Boosted, model: Column, values: Sequence[Column]) -> Column:
    """Probability of class 1 by the row's model; null where there is none."""
    sent = spark.sparkContext.broadcast(made)  # one number per cell of each model

    def judge(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for m, *x in frames:
            yield _by_model(m, x, sent.value.predict, np.float64, sent.value.table)

    return F.pandas_udf(judge, "double")(model, *[F.nanvl(v.cast("double"), F.lit(None)) for v in values])


def _by_model(models: pd.Series, columns: Sequence[pd.Series], of, kind, known=None) -> pd.Series:
    out, values = pd.Series(np.zeros(len(models), kind), index=models.index), np.stack([c.to_numpy(float) for c in columns], 1)
    for m, at in models.groupby(models).indices.items():
        out.iloc[at] = of(m, values[at]) if known is None or m in known else np.nan
    return out
