"""Operators that need a series at once: IIR filters, nearest-neighbour imputation, step reducers, functions of the user."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Operator


def design(kind: str, mode: str, order: int, cutoff: float | tuple[float, float], ripple: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth or Chebyshev (type 1) filter; cutoffs are shares of the Nyquist frequency.

    mode: lowpass, highpass, bandpass or bandstop, the last two with two cutoffs. By the analog prototype's poles, a
    frequency transform and the bilinear map.
    """
    angle = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    if kind == "butterworth":
        poles, gain = -np.sin(angle) + 1j * np.cos(angle), 1.0
    elif kind == "chebyshev1":
        eps = np.sqrt(10 ** (ripple / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = -np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * np.cos(angle)
        gain = np.prod(-poles).real / (np.sqrt(1 + eps * eps) if order % 2 == 0 else 1)
    else:
        raise ValueError(f"no design {kind!r}; give coefficients instead")
    zeros = np.zeros(0, complex)
    warped = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / 2)
    if mode == "lowpass":
        gain, poles = gain * warped[0] ** order, poles * warped[0]
    elif mode == "highpass":
        gain, zeros, poles = gain * (1 / np.prod(-poles)).real, np.zeros(order, complex), warped[0] / poles
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2 if mode == "bandpass" else width / 2 / poles
        root = np.sqrt(half**2 - centre**2)
        if mode == "bandpass":
            gain, zeros = gain * width**order, np.zeros(order, complex)
        else:
            gain, zeros = gain * (1 / np.prod(-poles)).real, np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
        poles = np.concatenate([half + root, half - root])
    gain = gain * (np.prod(4 - zeros) / np.prod(4 - poles)).real
    z, p = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    return gain * np.poly(z).real, np.poly(p).real


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The causal filter's output along the last axis of x, rows side by side, and its state at the end. From rest where no
    state (rows x order) is given."""
    x = np.atleast_2d(x)
    state = np.zeros((len(x), len(a) - 1)) if state is None else state.copy()
    out = np.empty(x.shape)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + state[:, 0]
        state[:, :-1] = state[:, 1:] + np.outer(v, b[1:-1]) - np.outer(y, a[1:-1])
        state[:, -1] = b[-1] * v - a[-1] * y
        out[:, i] = y
    return out, state


#: Rows of a filter's chunk.
CHUNK = 256


def chunked_filter(df: DataFrame, columns: list[str], b: np.ndarray, a: np.ndarray, keys: tuple[str, ...], time: str, size: int = CHUNK) -> DataFrame:
    """(keys, time, {c}_filtered). Chunks are filtered from rest, many side by side in one batch; the states between them are
    composed over a series' chunks by the filter's own transition matrix, and each chunk then gets what its first state adds."""
    keys, order = list(keys), max(len(a), len(b)) - 1
    b, a = (np.concatenate([np.asarray(c, float), np.zeros(order + 1 - len(c))]) / a[0] for c in (b, a))
    turn = np.zeros((order, order))  # the state after one sample of nothing
    turn[:, 0] = -a[1:]
    turn[np.arange(order - 1), np.arange(1, order)] = 1
    answers = np.empty((size, order))  # what a state adds to the samples after it
    power = np.eye(order)
    powers = [power]
    for i in range(size):
        answers[i] = power[0]
        power = turn @ power
        powers.append(power)

    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(*keys, time, *(F.col(c).cast("double").alias(c) for c in columns), F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("_chunk"))
    chunks = rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct(time, *columns))).alias("_r"))
    kept = chunks.select(*keys, "_chunk", F.col(f"_r.{time}").alias("_t"), *(F.col(f"_r.{c}").alias(f"_x{i}") for i, c in enumerate(columns)))

    @F.pandas_udf("struct<y:array<double>,s:array<double>>")
    def rest(found: pd.Series) -> pd.DataFrame:
        y, s = [None] * len(found), [None] * len(found)
        lengths = found.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            out, state = filtered(np.array([np.array(found.iloc[i], float) for i in at]).reshape(len(at), n), b, a)
            for j, i in enumerate(at):
                y[i], s[i] = out[j], state[j]
        return pd.DataFrame({"y": y, "s": s})

    solved = kept.select(*keys, "_chunk", "_t", *(rest(f"_x{i}").alias(f"_y{i}") for i in range(len(columns))))
    ends = solved.select(*keys, "_chunk", F.size("_t").alias("_n"), *(F.col(f"_y{i}.s").alias(f"_s{i}") for i in range(len(columns))))
    index = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def carried(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_chunk")
        out = {}
        for i in range(len(columns)):
            state, before = np.zeros(order), []
            for n, s in zip(own["_n"], own[f"_s{i}"]):
                before.append(state)
                state = powers[n] @ state + np.asarray(s)
            out[f"_s{i}"] = before
        return own[[*keys, "_chunk"]].assign(**out)

    states = ends.groupBy(*keys).applyInPandas(carried, index + ", _chunk int" + "".join(f", _s{i} array<double>" for i in range(len(columns))))

    @F.pandas_udf("array<double>")
    def finished(y: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v) + answers[: len(v)] @ np.asarray(z) for v, z in zip(y, s)])

    done = solved.join(states, [*keys, "_chunk"]).select(*keys, "_t", *(finished(F.col(f"_y{i}.y"), F.col(f"_s{i}")).alias(f"_z{i}") for i in range(len(columns))))
    out = done.select(*keys, F.explode(F.arrays_zip("_t", *(f"_z{i}" for i in range(len(columns))))).alias("_e"))
    return out.select(*keys, F.col("_e._t").alias(time), *(F.col(f"_e._z{i}").alias(f"{c}_filtered") for i, c in enumerate(columns)))


@dataclass
class NumericalFilter(Operator):
    """{c}_filtered by a designed filter, or by given coefficients (b, a), in chunks of rows. zero_phase: forwards and then
    backwards, from rest at both ends."""

    design: str = "butterworth"
    mode: str = "lowpass"
    order: int = 4
    cutoff: float | tuple[float, float] = 0.1
    ripple: float = 1.0
    coefficients: tuple | None = None
    zero_phase: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        b, a = map(np.asarray, self.coefficients) if self.coefficients else design(self.design, self.mode, self.order, self.cutoff, self.ripple)
        columns = self.values(df)
        out = chunked_filter(df, columns, b, a, self.keys, self.time)
        if not self.zero_phase:
            return out
        back = out.select(*self.keys, F.col(self.time).alias("_t"), (-F.unix_micros(F.col(self.time).cast("timestamp"))).alias("_back"), *(F.col(f"{c}_filtered").alias(c) for c in columns))
        again = chunked_filter(back, columns, b, a, self.keys, "_back")
        return again.join(back.select(*self.keys, "_t", "_back"), [*self.keys, "_back"]).select(*self.keys, F.col("_t").alias(self.time), *(f"{c}_filtered" for c in columns))


@dataclass
class NeighbourImputer(Operator):
    """Nulls become the (distance-weighted) mean of the nearest rows of the series that have the value, by the scaled Euclidean
    distance over the values both rows have. Distances are computed block by block."""

    n_neighbors: int = 5
    weights: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        columns, index, k, weighted, time = self.values(df), self.index(), self.n_neighbors, self.weights == "distance", self.time

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(time).reset_index(drop=True)
            x = own[columns].to_numpy(float)
            there, out = ~np.isnan(x), x.copy()
            zero = np.where(there, x, 0.0)
            for at in np.array_split(np.flatnonzero(~there.all(axis=1)), max(1, (~there.all(axis=1)).sum() // 256)):
                both = there[at].astype(float) @ there.T.astype(float)
                square = (zero[at] ** 2) @ there.T + there[at] @ (zero**2).T - 2 * zero[at] @ zero.T
                with np.errstate(invalid="ignore", divide="ignore"):
                    distance = np.sqrt(np.where(both > 0, np.maximum(square, 0) * len(columns) / both, np.inf))
                for row, d in zip(at, distance):
                    for c in np.flatnonzero(~there[row]):
                        near = np.flatnonzero(there[:, c] & np.isfinite(d))
                        near = near[np.argsort(d[near], kind="stable")[:k]]
                        if len(near):
                            w = np.where(d[near].min() == 0, (d[near] == 0).astype(float), 1 / np.maximum(d[near], 1e-300)) if weighted else np.ones(len(near))
                            out[row, c] = (x[near, c] * w).sum() / w.sum()
                        elif there[:, c].any():
                            out[row, c] = x[there[:, c], c].mean()
            return own[index].assign(**dict(zip(columns, out.T)))

        schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in index), *(f"{c} double" for c in columns)])
        return df.groupBy(*self.keys).applyInPandas(run, schema)


@dataclass
class StepReducer(Operator):
    """Principal components of each base's step columns ({base}_pc_{i}), or of all of them at once ({prefix}_pc_{i}); rows with nulls have none."""

    bases: tuple[str, ...] = ()
    components: int = 2
    prefix: str | None = None

    def _steps(self, df: DataFrame, base: str) -> list[str]:
        return sorted((c for c in df.columns if c.startswith(f"{base}_step_")), key=lambda c: int(c.rsplit("_", 1)[1]))

    def fit(self, df: DataFrame) -> StepReducer:
        blocks = {b: self._steps(df, b) for b in self.bases}
        if self.prefix:
            blocks = {self.prefix: [c for s in blocks.values() for c in s]}
        self.fitted = {}
        for name, steps in blocks.items():
            assembler = VectorAssembler(inputCols=steps, outputCol="_v", handleInvalid="skip")
            self.fitted[name] = (assembler, PCA(k=self.components, inputCol="_v", outputCol="_p").fit(assembler.transform(df)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, (assembler, model) in self.fitted.items():
            made = model.transform(assembler.transform(df)).select(*self.index(), *(vector_to_array("_p")[i].alias(f"{name}_pc_{i}") for i in range(self.components)))
            out = out.join(made, self.index(), "left")
        return out.select(*self.index(), *(f"{n}_pc_{i}" for n in self.fitted for i in range(self.components)))


@dataclass
class FunctionTransformer(Operator):
    """A user's DataFrame function and its inverse; check compares a round trip on up to 100 rows at fit."""

    func: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    inverse: Callable[[DataFrame], DataFrame] | None = None
    check: bool = True

    def fit(self, df: DataFrame) -> FunctionTransformer:
        if self.check and self.inverse is not None:
            some = df.limit(100)
            columns = self.values(df)
            back = self.inverse(self.func(some)).select(*self.index(), *(F.col(c).alias(f"_{c}") for c in columns))
            off = some.join(back, self.index()).filter(" or ".join(f"abs(`{c}` - `_{c}`) > 1e-6 * (1 + abs(`{c}`))" for c in columns))
            if off.limit(1).count():
                raise ValueError("the inverse does not undo the function")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.func(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self.inverse(df)
