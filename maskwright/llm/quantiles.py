"""Percentiles of very large numeric columns (problem 5).

Values are quantised to a bounded ordered universe: the upper ``bits`` bits of the order-preserving
image of a double. A summary is a set of counts on the nodes of the dyadic tree over that universe, compressed
bottom-up so that a node family below ``n / k`` moves into its parent. Summaries merge by adding the counts of equal nodes and compressing again.

Each task makes one summary per group, as one row of arrays (at most 3k nodes), before the only large shuffle. Summaries are merged in a tree: those
of ``FAN_IN`` neighbouring tasks first, the results after that, so that no task ever holds more than about ``FAN_IN`` summaries of a group.

Guarantee: with ``k = ceil(bits / eps)`` the rank of every reported value differs from the wanted
rank by at most ``eps * n`` (deterministic), up to the quantisation of values (relative width
2^(12 - bits)). Merging keeps the guarantee, because every partial summary satisfies it for its own
count and errors add up to ``eps`` times the sum of counts.

Defined results: null and NaN are not values and are left out; -0.0 counts as 0.0; infinities are ordinary extreme values; a
group without any value has no row; groups may be null and form a group of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def to_cells(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells 0 .. 2^bits - 1, in the order of the values."""
    v = np.where(values == 0, 0.0, values).astype(np.float64)
    u = v.view(np.int64)
    ordered = np.where(u < 0, ~u, u | np.int64(-0x8000000000000000)).view(np.uint64)
    return (ordered >> np.uint64(64 - bits)).astype(np.int64)


def from_cells(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The middle value of each cell."""
    mid = (cells.astype(np.uint64) << np.uint64(64 - bits)) | np.uint64(1 << (63 - bits))
    u = mid.view(np.int64)
    raw = np.where(u < 0, u & np.int64(0x7FFFFFFFFFFFFFFF), ~u)
    out = raw.view(np.float64)
    return np.where(np.isnan(out), np.copysign(np.inf, out), out)


def size_for(eps: float, bits: int = BITS) -> int:
    return max(1, math.ceil(bits / eps))


def compress(nodes: np.ndarray, counts: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Compressed summary. Node 1 is the root, node ``2^bits + cell`` a leaf; equal nodes are added first."""
    nodes, inv = np.unique(nodes, return_inverse=True)
    counts = np.bincount(inv, counts, minlength=len(nodes)).astype(np.int64)
    limit = int(counts.sum()) // k
    if limit < 1:
        return nodes, counts
    level = np.frexp(nodes.astype(np.float64))[1] - 1
    done_n: list[np.ndarray] = []
    done_c: list[np.ndarray] = []
    cur_n, cur_c = nodes[level == bits], counts[level == bits]
    for depth in range(bits, 0, -1):
        own = level == depth - 1
        parent_n, parent_c = nodes[own], counts[own]
        up, at = np.unique(np.concatenate([cur_n >> 1, parent_n]), return_inverse=True)
        kids = np.bincount(at[: len(cur_n)], cur_c, minlength=len(up)).astype(np.int64)
        mine = np.bincount(at[len(cur_n) :], parent_c, minlength=len(up)).astype(np.int64)
        folds = (kids > 0) & (kids + mine <= limit)
        stay = ~folds[at[: len(cur_n)]]
        done_n.append(cur_n[stay])
        done_c.append(cur_c[stay])
        mine = mine + np.where(folds, kids, 0)
        cur_n, cur_c = up[mine > 0], mine[mine > 0]
    done_n.append(cur_n)
    done_c.append(cur_c)
    return np.concatenate(done_n), np.concatenate(done_c)


def quantile(nodes: np.ndarray, counts: np.ndarray, q: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Values at the quantiles: nodes in post-order of their right ends, smaller nodes first."""
    depth = np.frexp(nodes.astype(np.float64))[1] - 1
    width = np.int64(1) << (bits - depth).astype(np.int64)
    right = (nodes - (np.int64(1) << depth.astype(np.int64)) + 1) * width - 1
    order = np.lexsort((width, right))
    cum = np.cumsum(counts[order])
    at = np.searchsorted(cum, np.ceil(np.asarray(q) * cum[-1]).clip(1), side="left")
    return from_cells(right[order][at], bits)


def _groups(batch: pa.RecordBatch, columns: list[int]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(group values, row numbers) of a batch by some of its columns; nulls are a value."""
    if batch.num_rows == 0:
        return
    code = np.zeros(batch.num_rows, np.int64)
    dictionaries = []
    for i in columns:
        d = batch.column(i).dictionary_encode(null_encoding="encode")
        values = d.dictionary.to_pylist()
        dictionaries.append(values)
        code = code * len(values) + d.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    for c, rows in zip(codes.tolist(), np.split(order, first[1:])):
        key = []
        for values in reversed(dictionaries):
            c, j = divmod(c, len(values))
            key.append(values[j])
        yield tuple(reversed(key)), rows


FAN_IN = 256
_HELD = 4_000_000  # nodes a task holds before it hands out what it has


class _Summaries:
    """Summaries of one task, by group; group values are kept as they came."""

    def __init__(self, k: int, bits: int) -> None:
        self.k, self.bits = k, bits
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def add(self, key: tuple, cells: np.ndarray) -> None:
        nodes, counts = np.unique(cells, return_counts=True)
        old = self.held.get(key)
        if old is not None:
            self.size -= len(old[0])
            nodes, counts = np.concatenate([old[0], nodes]), np.concatenate([old[1], counts])
            if len(nodes) > 6 * self.k:
                nodes, counts = compress(nodes, counts, self.k, self.bits)
        self.held[key] = nodes, counts
        self.size += len(nodes)

    def rows(self) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        for key, found in self.held.items():
            yield key, *compress(*found, self.k, self.bits)
        self.held, self.size = {}, 0


_BODY = "part bigint, n bigint, nodes array<bigint>, counts array<bigint>"


def summaries(df: DataFrame, value_col: str, groups: dict[str, Column], eps: float = 0.005, bits: int = BITS, separate: bool = False) -> DataFrame:
    """Mergeable summaries: the group columns, ``part`` (the task), ``n``, ``nodes``, ``counts``; one row per group and task.

    ``separate``: the group columns are groupings of their own, all fed by one pass over the rows; rows then have ``grouping`` (the column's name) and
    ``key`` (its value as a string) instead.
    """
    names = list(groups)
    k = size_for(eps, bits)
    shown = {g: c.cast("string") if separate else c for g, c in groups.items()}
    source = df.select(*[c.alias(g) for g, c in shown.items()], F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = "grouping string, key string" if separate else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    columns = ["grouping", "key"] if separate else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        held = _Summaries(k, bits)
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(held.rows())
            if found:
                heads = list(zip(*(key for key, _, _ in found))) if columns else []
                body = [[part] * len(found), [int(c.sum()) for _, _, c in found], [n for _, n, _ in found], [c for _, _, c in found]]
                kinds = [*types, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip([*heads, *body], kinds)], names=[*columns, "part", "n", "nodes", "counts"])

        for batch in batches:
            types = [pa.string(), pa.string()] if separate else [batch.schema.field(i).type for i in range(len(names))]
            cells = to_cells(batch.column(len(names)).to_numpy(zero_copy_only=False), bits) + (1 << bits)
            for group in ([i] for i in range(len(names))) if separate else [range(len(names))]:
                for key, rows in _groups(batch, list(group)):
                    held.add((names[group[0]], *key) if separate else key, cells[rows])
            if held.size > _HELD:
                yield from flush()
        yield from flush()

    return source.mapInArrow(run, f"{keys}, {_BODY}" if columns else _BODY)


def merge(parts: DataFrame, groups: list[str], eps: float = 0.005, bits: int = BITS) -> DataFrame:
    """One summary per group, and per ``FAN_IN`` parts, from the summaries of days, partitions or both; columns as those of ``summaries``."""
    k = size_for(eps, bits)
    fields = [f for f in parts.schema.fields if f.name in groups]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), _BODY])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, counts = _add(pdf, k, bits)
        head = {f.name: [pdf[f.name].iloc[0]] for f in fields}
        return pd.DataFrame({**head, "part": [pdf["part"].iloc[0]], "n": [int(counts.sum())], "nodes": [nodes], "counts": [counts]})

    rows = parts.select(*groups, F.floor(F.col("part") / FAN_IN).cast("bigint").alias("part"), "n", "nodes", "counts")
    return rows.groupBy(*groups, "part").applyInPandas(one, ddl)


def _add(pdf: pd.DataFrame, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return compress(np.concatenate(pdf["nodes"].to_list()).astype(np.int64), np.concatenate(pdf["counts"].to_list()).astype(np.int64), k, bits)


def percentiles(summary: DataFrame, groups: list[str], quantiles: list[float], eps: float = 0.005, bits: int = BITS) -> DataFrame:
    """``groups, n, rank_error, q, value``: one row per group and quantile, from summary rows of any number of partitions and days.

    A group's rows are bounded by the nodes of its summaries, never by its values.
    """
    k = size_for(eps, bits)
    added = merge(summary, groups, eps, bits)
    fields = [f for f in added.schema.fields if f.name in groups]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n bigint", "rank_error bigint", "q double", "value double"])
    qs = np.asarray(quantiles, float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, counts = _add(pdf, k, bits)
        total = int(counts.sum())
        head = {f.name: [pdf[f.name].iloc[0]] * len(qs) for f in fields}
        return pd.DataFrame({**head, "n": total, "rank_error": math.ceil(eps * total), "q": qs, "value": quantile(nodes, counts, qs, bits)})

    return added.groupBy(*groups).applyInPandas(one, ddl)


def rank_check(df: DataFrame, value_col: str, key: Column, found: DataFrame, bits: int = BITS) -> DataFrame:
    """``key, q, n, within``: does the exact rank of every reported value lie within the stated error? ``found``: ``key, n, rank_error, q, value``.

    One count per row and quantile: values below the reported one's cell and values up to it. Cells are compared, as values are quantised.
    """
    width = 2.0 ** (12 - bits)
    v = F.col(value_col).cast("double")
    rows = df.select(key.alias("key"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    met = rows.join(found.select(F.col("key").alias("k"), "q", "rank_error", "value"), F.col("key").eqNullSafe(F.col("k")))
    slack = F.abs("value") * width + 1e-300
    ranks = met.groupBy("key", "q", "rank_error").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value") - slack).alias("below"), F.count_if(F.col("v") <= F.col("value") + slack).alias("upto"))
    wanted = F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))
    return ranks.select("key", "q", "n", ((F.col("below") - F.col("rank_error") < wanted) & (wanted <= F.col("upto") + F.col("rank_error"))).alias("within"))
