"""Consensus from several annotators' labels (problem 4).

Triplet moment method. Pairwise agreement of annotators, corrected for the agreement that chance alone
gives, factorises into the annotators' accuracies: ``m_ij = t_i t_j``, so ``t_i^2 = m_ij m_ik / m_jk`` over triplets.
The same triplets per label give each annotator's accuracy on it and, from the pairs that do not agree, where the rest of the annotator's
votes goes: P(stated | true). A vote for a label counts with its log-odds, log P(stated | true). (One accuracy per annotator gives 1 to 2 %
fewer right labels where people have habits.) Starts and ends are voted on separately, weighted by
the log-odds of the accuracies that the triplets of boundary agreement give.

Counts of pairs are summed in the tasks and stay in a distributed table. The driver gets agreements only: annotators squared x labels
numbers, at most ``MAX_CELLS``, and annotators x labels squared sums; both whatever the number of items. An
item's votes are at most one per annotator, the latest judgement by time.

Defined results: a null label, annotator or item counts for nothing (an item with only such judgements has no row);
of judgements at the same time the one with the largest label, then start, then end counts; exact repeats count
once; ties of the vote go to the smaller label, start or end; agreement of a single vote is null; an
annotator who shares no item with two others keeps the overall mean accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import cut_lineage

MAX_ANNOTATORS = 2000
MAX_LABELS = 64
MAX_CELLS = 8_000_000  # annotators squared x labels, as held on the driver


def latest_votes(df: DataFrame, item: str = "item_id", annotator: str = "annotator", label: str = "label",
                 start: str = "start", end: str = "end", at: str = "labelled_at") -> DataFrame:
    """``item_id, annotator, label, start, end``: each annotator's latest judgement. One partial aggregate, no window over an item."""
    seen = df.where(F.col(label).isNotNull() & F.col(item).isNotNull() & F.col(annotator).isNotNull())
    order = F.struct(F.col(at).alias("at"), F.col(label).alias("label"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
    return (
        seen.groupBy(F.col(item).alias("item_id"), F.col(annotator).alias("annotator")).agg(F.max(order).alias("v"))
        .select("item_id", "annotator", "v.label", "v.start", "v.end")
    )


def votes_by_item(votes: DataFrame) -> DataFrame:
    """``item_id, votes``: an array with at most one vote per annotator."""
    return votes.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "label", "start", "end"))).alias("votes"))


@dataclass
class Reliability:
    """What the votes are weighted with; its size depends on annotators and labels only."""

    annotators: list[str]
    labels: list[str]
    accuracy: np.ndarray  # A
    habits: np.ndarray  # A x true x stated, log-probabilities
    prior: np.ndarray  # L, log-probabilities
    start: np.ndarray  # A
    end: np.ndarray  # A
    n: np.ndarray  # judgements of each annotator


_MOMENTS = "kind string, a int, b int, x int, y int, n bigint"


def pair_moments(items: DataFrame, annotators: list[str], labels: list[str]) -> DataFrame:
    """Counts of pairs of votes on one item, summed inside each task: kind ``label`` (a said x, b said y),
    ``start``/``end`` (a and b gave the same, x = 1, or not, x = 0), ``one`` (a said x)."""
    who = {v: i for i, v in enumerate(annotators)}
    what = {v: i for i, v in enumerate(labels)}
    A, L = len(annotators), len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}
        for batch in batches:
            a: list[int] = []
            x: list[int] = []
            s: list[int] = []
            e: list[int] = []
            sizes: list[int] = []
            for votes in batch.column(0).to_pylist():
                sizes.append(len(votes))
                for v in votes:
                    a.append(who[v["annotator"]])
                    x.append(what[v["label"]])
                    s.append(-1 if v["start"] is None else v["start"])
                    e.append(-1 if v["end"] is None else v["end"])
            ua, ux, us, ue = (np.asarray(c, np.int64) for c in (a, x, s, e))
            item = np.repeat(np.arange(len(sizes)), sizes)
            _count(total, "one", ua * L + ux)
            # all ordered pairs of an item's votes, by the distance of their places in the item
            for d in range(1, max(sizes, default=1)):
                i = np.flatnonzero(item[d:] == item[:-d])
                j = i + d
                for p, q in ((i, j), (j, i)):
                    _count(total, "label", ((ua[p] * A + ua[q]) * L + ux[p]) * L + ux[q])
                    _count(total, "start", (ua[p] * A + ua[q]) * 2 + (us[p] == us[q]))
                    _count(total, "end", (ua[p] * A + ua[q]) * 2 + (ue[p] == ue[q]))
        rows = {"kind": [], "a": [], "b": [], "x": [], "y": [], "n": []}
        for (kind, code), n in total.items():
            y = x = b = 0
            if kind == "one":
                a0, x = divmod(code, L)
            elif kind == "label":
                code, y = divmod(code, L)
                code, x = divmod(code, L)
                a0, b = divmod(code, A)
            else:
                code, x = divmod(code, 2)
                a0, b = divmod(code, A)
            for k, v in zip(rows, (kind, a0, b, x, y, n)):
                rows[k].append(v)
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    parts = items.select("votes").mapInArrow(run, _MOMENTS)
    return parts.groupBy("kind", "a", "b", "x", "y").agg(F.sum("n").alias("n"))


def _count(total: dict[tuple[str, int], int], kind: str, codes: np.ndarray) -> None:
    u, n = np.unique(codes, return_counts=True)
    for c, k in zip(u.tolist(), n.tolist()):
        total[kind, c] = total.get((kind, c), 0) + k


def triplet(m: np.ndarray, w: np.ndarray, rounds: int = 30, top: float = 0.98) -> np.ndarray:
    """Solves ``m_ij = t_i t_j`` (off the diagonal, weights w): ratio of summed triplets first, then the same
    triplets with the solved partners in place of the noisy ``m_jk``, which uses every pair."""
    n = len(m)
    w = w * (1 - np.eye(n))
    mw = m * w
    den = ((w @ mw) * w).sum(axis=1)
    num = ((mw @ w) * mw).sum(axis=1)
    ok = (den > 1e-9) & (num > 0)
    t = np.where(ok, np.sqrt(np.where(ok, num, 0) / np.where(ok, den, 1)), np.nan)
    mean = np.nanmean(t) if ok.any() else 0.5
    t = np.clip(np.where(ok, t, mean), 0.02, top)
    for _ in range(rounds):
        den = w @ (t * t)
        new = np.where(den > 1e-9, (mw @ t) / np.maximum(den, 1e-9), mean)
        t = np.clip(0.5 * t + 0.5 * new, 0.0, top + 0.015)
    return t


@dataclass
class Agreements:
    """What the driver holds of the pair counts."""

    one: np.ndarray  # A x L: judgements
    both: np.ndarray  # A x A: items judged by both
    same: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per label: a, b, items that both gave it
    edges: dict[str, tuple[np.ndarray, np.ndarray]]  # start, end: A x A agreements, A x A pairs


def agreements(moments: DataFrame, A: int, L: int) -> Agreements:
    """Agreements from the table of pair counts; pairs that do not agree are only summed up."""
    label = F.col("kind") == "label"
    rows = moments.where(~label | (F.col("x") == F.col("y"))).select("kind", "a", "b", "x", "n").toPandas()
    pairs = moments.where(label).groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    one, both = np.zeros((A, L)), np.zeros((A, A))
    both[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["n"].to_numpy()
    part = {k: tuple(p[c].to_numpy() for c in "abxn") for k, p in rows.groupby("kind")}
    none = (np.zeros(0, np.int64),) * 4
    a, _, x, n = part.get("one", none)
    one[a, x] = n
    a, b, x, n = part.get("label", none)
    same = [(a[x == k], b[x == k], n[x == k]) for k in range(L)]
    edges = {}
    for kind in ("start", "end"):
        yes, every = np.zeros((A, A)), np.zeros((A, A))
        a, b, x, n = part.get(kind, none)
        np.add.at(every, (a, b), n)
        np.add.at(yes, (a, b), n * x)
        edges[kind] = yes, every
    return Agreements(one, both, same, edges)


def solve(moments: DataFrame, annotators: list[str], labels: list[str]) -> Reliability:
    """Accuracies from agreements, then the habits from one weighted sum over all pair counts."""
    A, L = len(annotators), len(labels)
    g = agreements(moments, A, L)
    n_i, n_ij = g.one.sum(axis=1), g.both
    per = np.maximum(n_ij, 1)
    stated = (g.one + 0.5) / (g.one + 0.5).sum(axis=1, keepdims=True)

    def spread(k: int) -> np.ndarray:
        out = np.zeros((A, A))
        out[g.same[k][0], g.same[k][1]] = g.same[k][2]
        return out

    # chance: the agreement of two annotators who say each label as often as they do, on unrelated items
    rate = sum((spread(k) for k in range(L)), np.zeros((A, A))) / per
    chance = stated @ stated.T
    t = triplet((rate - chance) / np.maximum(1 - chance, 1e-6), n_ij)
    prior = (stated * (n_i * t)[:, None]).sum(axis=0)
    prior /= prior.sum()
    # covariance of the indicators "said label k": r_i r_j with r = accuracy gain x deviation of the true label
    r = np.stack([triplet(spread(k) / per - np.outer(stated[:, k], stated[:, k]), n_ij, top=0.5) for k in range(L)])
    moved = np.zeros((A, L, L))  # annotator, said, label of the other: pairs weighted with the other's r
    table = moments.sparkSession.createDataFrame(
        pd.DataFrame({"b": np.tile(np.arange(A), L), "y": np.repeat(np.arange(L), A), "r": r.ravel()}), "b int, y int, r double")
    # annotators x labels rows
    sums = moments.where("kind = 'label'").join(F.broadcast(table), ["b", "y"]).groupBy("a", "x", "y").agg(F.sum(F.col("n") * F.col("r")).alias("v")).toPandas()
    moved[sums["a"].to_numpy(), sums["x"].to_numpy(), sums["y"].to_numpy()] = sums["v"].to_numpy()
    weighed = np.stack([n_ij @ (r[k] * stated[:, k]) for k in range(L)])  # what chance gives
    norm = np.maximum(np.stack([n_ij @ r[k] ** 2 for k in range(L)]), 1e-9)
    hit = np.clip(t + (1 - t) / L, 0.05, 0.99)
    own = np.where(np.eye(L, dtype=bool)[None], hit[:, None, None], ((1 - hit) / max(L - 1, 1))[:, None, None])
    habits = own.copy()
    for _ in range(3):
        for k in range(L):
            dev = np.sqrt(max(prior[k] * (1 - prior[k]), 1e-4))
            gain = (moved[:, :, k] - stated * weighed[k][:, None]) / (dev * norm[k][:, None])
            habits[:, k, :] = np.clip(stated + (1 - prior[k]) * gain, 1e-3, 1)
        # few judgements say little: shrink towards the annotator's own accuracy
        weight = (n_i[:, None] * prior[None, :])[:, :, None]
        habits = (habits * weight + own * 8) / (weight + 8)
        habits /= habits.sum(axis=2, keepdims=True)
        # prior that explains the stated labels through the habits
        for _ in range(20):
            mix = np.einsum("l,als->as", prior, habits)
            prior = np.einsum("as,als->l", g.one / np.maximum(mix, 1e-9), habits) * prior
            prior /= prior.sum()
    edges = {k: np.clip(triplet(yes / np.maximum(n, 1), n), 0.05, 0.99) for k, (yes, n) in g.edges.items()}
    accuracy = np.einsum("l,all->a", prior, habits)
    return Reliability(annotators, labels, accuracy, np.log(habits), np.log(np.maximum(prior, 1e-6)), edges["start"], edges["end"], n_i)


def _vote(values: list[int | None], weights: list[float]) -> int | None:
    score: dict[int, float] = {}
    for v, w in zip(values, weights):
        if v is not None:
            score[v] = score.get(v, 0.0) + w
    return min(score, key=lambda v: (-score[v], v)) if score else None


_CONSENSUS = "label string, confidence double, start_pos bigint, end_pos bigint, n_votes int, agreement double"


def combine(items: DataFrame, model: Reliability) -> DataFrame:
    """``item_id, label, confidence, start_pos, end_pos, n_votes, agreement`` (share of agreeing pairs of votes)."""
    shared = items.sparkSession.sparkContext.broadcast(model)  # annotators x labels^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Reliability = shared.value
        who = {v: i for i, v in enumerate(r.annotators)}
        what = {v: i for i, v in enumerate(r.labels)}
        wrong = np.log(20.0)  # a wrong boundary is one of many
        ws = np.log(r.start / (1 - r.start)) + wrong
        we = np.log(r.end / (1 - r.end)) + wrong
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for votes in batch.column(1).to_pylist():
                a = [who[v["annotator"]] for v in votes]
                x = [what[v["label"]] for v in votes]
                score = r.prior + r.habits[a, :, x].sum(axis=0)
                p = np.exp(score - score.max())
                p /= p.sum()
                k = int(np.argmax(np.round(p, 9)))
                n = len(votes)
                same = sum(c * (c - 1) for c in np.bincount(x).tolist())
                row = (r.labels[k], float(p[k]), _vote([v["start"] for v in votes], ws[a].tolist()), _vote([v["end"] for v in votes], we[a].tolist()), n, same / (n * (n - 1)) if n > 1 else None)
                for col, v in zip(out, row):
                    col.append(v)
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            names = ["item_id", *[f.split()[0] for f in _CONSENSUS.split(", ")]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types)]], names=names)

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "votes").mapInArrow(run, f"item_id {kind}, {_CONSENSUS}")


def reliability_of(votes: DataFrame, items: DataFrame) -> Reliability:
    """Fits the triplet model on all votes."""
    annotators = sorted(r[0] for r in votes.select("annotator").distinct().limit(MAX_ANNOTATORS + 1).collect())
    labels = sorted(r[0] for r in votes.select("label").distinct().limit(MAX_LABELS + 1).collect())
    if len(annotators) > MAX_ANNOTATORS or len(labels) > MAX_LABELS or len(annotators) ** 2 * len(labels) > MAX_CELLS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators, {MAX_LABELS} labels or {MAX_CELLS} pairs of annotators x labels")
    if not annotators:
        return Reliability([], [], *(np.zeros(s) for s in (0, (0, 0, 0), 0, 0, 0, 0)))
    return solve(cut_lineage(pair_moments(items, annotators, labels)), annotators, labels)


def consensus(df: DataFrame, **columns: str) -> DataFrame:
    """Consensus label and boundaries of every item."""
    votes = cut_lineage(latest_votes(df, **columns))
    items = votes_by_item(votes)
    return combine(items, reliability_of(votes, items))


def annotator_reliability(df: DataFrame, **columns: str) -> DataFrame:
    """``annotator, n, accuracy, start_accuracy, end_accuracy``."""
    votes = cut_lineage(latest_votes(df, **columns))
    r = reliability_of(votes, votes_by_item(votes))
    rows = [(a, int(n), float(x), float(s), float(e)) for a, n, x, s, e in zip(r.annotators, r.n, r.accuracy, r.start, r.end)]
    return df.sparkSession.createDataFrame(rows, "annotator string, n bigint, accuracy double, start_accuracy double, end_accuracy double")


def agreement(df: DataFrame, **columns: str) -> DataFrame:
    """Mean over the items of the share of agreeing pairs of votes, as a one-row table."""
    return consensus(df, **columns).agg(F.avg("agreement").alias("agreement"), F.count(F.lit(1)).alias("items"))
