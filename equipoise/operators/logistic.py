"""L2-regularised logistic regression of several feature sets at once, by iteratively reweighted least squares.

Each step reads the rows once for all sets that haven't converged: a task adds up, per set, the gradient, the weighted Gram
matrix and the log-loss at the set's coefficients; the sums meet by (set, place) and a small system per set is solved on the
driver.  A step that raises the objective is halved.  What reaches the driver are (features + 1)^2 numbers per set.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A set has converged when no coefficient moves by more than this; steps at most.
TOLERANCE, MOST_STEPS = 1e-11, 200


@dataclass
class LogisticFit:
    """Coefficients of one feature set."""

    features: list[str]
    intercept: float
    coefficients: np.ndarray

    def probability(self) -> Column:
        """P(label = 1) of a row with these features."""
        line = F.lit(float(self.intercept))
        for name, b in zip(self.features, self.coefficients):
            line = line + F.col(f"`{name}`") * F.lit(float(b))
        return 1 / (1 + F.exp(-line))


def _sums(rows: DataFrame, betas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per set: log-loss, gradient and Gram matrix of its rows (set, y, x) at ``betas``, flat."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(1 + len(b) + len(b) ** 2) for s, b in betas.items()}
        for batch in batches:
            of, y, lists = batch.column("set").to_numpy(), batch.column("y").to_numpy(), batch.column("x")
            for s, beta in betas.items():
                mine = np.flatnonzero(of == s)
                if not len(mine):
                    continue
                x = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                x = np.column_stack([np.ones(len(mine)), x])
                line = x @ beta
                p = 0.5 * (1 + np.tanh(line / 2))
                w = p * (1 - p)
                own = total[s]
                own[0] += np.logaddexp(0, np.where(y[mine] > 0.5, -line, line)).sum()
                own[1:1 + len(beta)] += x.T @ (p - y[mine])
                own[1 + len(beta):] += ((x * w[:, None]).T @ x).ravel()
        yield pa.record_batch({"set": pa.array(list(total), pa.int32()), "sums": pa.array(list(total.values()), pa.list_(pa.float64()))})

    sent = rows.mapInArrow(add, "set int, sums array<double>")
    met = sent.select("set", F.posexplode("sums").alias("place", "value")).groupBy("set", "place").agg(F.sum("value").alias("value"))
    out = {s: np.zeros(1 + len(b) + len(b) ** 2) for s, b in betas.items()}
    for r in met.collect():
        out[r["set"]][r["place"]] = r["value"]
    return out


def fit_logistics(df: DataFrame, sets: Mapping[str, Sequence[str]], label: str, C: float = 1.0,
                  of_set: str | None = None) -> dict[str, LogisticFit]:
    """One fit per named feature set: least sum of log-loss plus |coefficients|^2 / (2 C), the intercept free.

    ``of_set``: a column that names the only set a row belongs to; without it all rows belong to all.  A row that lacks the
    label or a feature isn't in the set.  ``df`` is read once a step.
    """
    names = list(sets)
    each = []
    for i, name in enumerate(names):
        x = F.array(*[F.col(f"`{c}`").cast("double") for c in sets[name]]).cast("array<double>")
        whole = F.col(label).isNotNull()
        for c in sets[name]:
            whole = whole & F.col(f"`{c}`").isNotNull()
        if of_set is not None:
            whole = whole & (F.col(of_set) == name)
        each.append(F.when(whole, F.struct(F.lit(i).alias("set"), F.col(label).cast("double").alias("y"), x.alias("x"))))
    rows = df.select(F.inline(F.filter(F.array(*each), lambda s: s.isNotNull())))
    beta = {i: np.zeros(1 + len(sets[n])) for i, n in enumerate(names)}
    best: dict[int, tuple[float, np.ndarray]] = {}
    done: dict[int, np.ndarray] = {}
    for _ in range(MOST_STEPS):
        if not beta:
            break
        for s, sums in _sums(rows, beta).items():
            b, d = beta[s], len(beta[s])
            ridge = np.append(0.0, np.full(d - 1, 1 / C))
            objective = sums[0] + 0.5 * (ridge * b * b).sum()
            if s in best and objective > best[s][0] + 1e-12 * abs(best[s][0]):
                beta[s] = (b + best[s][1]) / 2
            else:
                best[s] = objective, b
                gram = sums[1 + d:].reshape(d, d) + np.diag(ridge)
                beta[s] = b - np.linalg.lstsq(gram, sums[1:1 + d] + ridge * b, rcond=None)[0]
            if np.abs(beta[s] - best[s][1]).max() <= TOLERANCE:
                done[s] = beta.pop(s)
    done |= beta
    return {n: LogisticFit(list(sets[n]), float(done[i][0]), done[i][1:]) for i, n in enumerate(names)}
