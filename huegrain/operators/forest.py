"""Zones from a random forest over pairs of clusters: cross-validated probabilities that two clusters are one zone, then complete linkage.

A brand's pairs, at most those of the gamut's cells whatever the number of products, are binned once and packed into one row. Tasks are
(brand, fold, a few trees): each grows its trees level by level on the other folds, with histograms of bins, and votes on its own fold;
votes are added up by Spark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .orders import nearest_chain_linkage

FEATURES = ["ciede2000", "delta_l", "delta_chroma", "delta_hue", "mean_l", "mean_chroma", "min_chroma", "max_chroma", "mean_hsb_sat", "delta_hsb_sat", "product_ratio"]
_BINS = 64


def binned(x: np.ndarray) -> np.ndarray:
    """(features, rows): the number of each value's bin, bins of equal shares of the rows."""
    out = np.empty(x.shape[::-1], np.uint8)
    for i, column in enumerate(x.T):
        cuts = np.unique(np.quantile(column, np.arange(1, _BINS) / _BINS)) if len(column) else []
        out[i] = np.searchsorted(cuts, column, side="left")
    return out


def stratified_folds(y: np.ndarray, order: np.ndarray, folds: int) -> np.ndarray:
    """Each class dealt to the folds in turn, in the order of ``order``."""
    fold = np.empty(len(y), np.int8)
    for label in (False, True):
        rows = np.flatnonzero(y == label)
        fold[rows[np.argsort(order[rows], kind="stable")]] = np.arange(len(rows)) % folds
    return fold


def grow(x: np.ndarray, y: np.ndarray, times: np.ndarray, weight: np.ndarray, depth: int, leaf: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over rows drawn ``times``: (feature, bin, value) of each node, node i's children being 2i + 1 and 2i + 2; feature -1 is a leaf.

    Each node tries the root of the number of features; the split with the lowest Gini impurity that leaves ``leaf`` rows on both sides."""
    n_features = len(x)
    tries = max(1, int(np.sqrt(n_features)))
    feature, cut, value = np.full(2 ** (depth + 1) - 1, -1, np.int8), np.zeros(2 ** (depth + 1) - 1, np.uint8), np.zeros(2 ** (depth + 1) - 1)
    rows = np.flatnonzero(times)
    at = np.zeros(len(rows), np.int64)  # the node of each row, counted within its level
    for level in range(depth + 1):
        width, base = 2**level, 2**level - 1
        mass = np.bincount(at, weight[rows], width)
        hits = np.bincount(at, weight[rows] * y[rows], width)
        value[base : base + width] = np.divide(hits, mass, out=np.zeros(width), where=mass > 0)
        if level == depth or not len(rows):
            break
        best, chosen = np.full(width, 1e-12), np.full(width, -1)
        where = np.zeros(width, np.int64)
        tried = np.argsort(random.random((width, n_features)), axis=1)[:, :tries]
        purity = np.divide(hits * hits + (mass - hits) ** 2, mass, out=np.zeros(width), where=mass > 0)
        for j in range(tries):
            key = at * _BINS + x[tried[at, j], rows]
            n, m, h = (np.bincount(key, w, width * _BINS).reshape(width, _BINS).cumsum(1) for w in (times[rows], weight[rows], weight[rows] * y[rows]))
            other = [t[:, -1:] - t for t in (n, m, h)]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (h * h + (m - h) ** 2) / m + (other[2] ** 2 + (other[1] - other[2]) ** 2) / other[1] - purity[:, None]
            gain[(n < leaf) | (other[0] < leaf)] = -1
            place = gain.argmax(1)
            gain = gain[np.arange(width), place]
            better = gain > best
            best[better], where[better], chosen[better] = gain[better], place[better], tried[better, j]
        feature[base : base + width], cut[base : base + width] = chosen, where
        goes = chosen[at] >= 0
        rows, at = rows[goes], at[goes]
        at = 2 * at + (x[chosen[at], rows] > where[at])
    return feature, cut, value


def vote(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row ends in."""
    feature, cut, value = tree
    at = np.zeros(x.shape[1], np.int64)
    moving = np.arange(x.shape[1])
    while len(moving):
        moving = moving[feature[at[moving]] >= 0]
        node = at[moving]
        at[moving] = 2 * node + 1 + (x[feature[node], moving] > cut[node])
    return value[at]


def _votes(trees: int, block: int, depth: int, leaf: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, fold, first, blob in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, x, y, folds = pickle.loads(blob)
                held, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
                total = np.zeros(len(held))
                n = [(~y[rest]).sum(), y[rest].sum()]
                weight = np.where(y[rest], *(len(rest) / (2 * max(1, k)) for k in n[::-1]))  # classes weigh alike
                fitted, seen = np.ascontiguousarray(x[:, rest]), np.ascontiguousarray(x[:, held])
                for tree in range(first, min(first + block, trees)):
                    random = np.random.default_rng([seed, fold, tree])
                    times = np.bincount(random.integers(0, len(rest), len(rest)), minlength=len(rest)) if len(rest) else np.zeros(0, int)
                    total += vote(grow(fitted, y[rest].astype(float), times, weight * times, depth, leaf, random), seen)
                yield pa.RecordBatch.from_arrays([pa.array([by] * len(held), pa.string()), pa.array(a[held], pa.int64()), pa.array(b[held], pa.int64()), pa.array(total, pa.float64())], names=["by", "a", "b", "votes"])

    return run


def out_of_fold(pairs: DataFrame, label: str, key: list[str], trees: int = 200, depth: int = 8, leaf: int = 10, folds: int = 5, seed: int = 42, block: int = 25) -> DataFrame:
    """``pairs`` with ``p``: the probability of ``label`` by a forest of the brand (the first of ``key``) that was fitted on the other folds. Classes
    weigh alike and are spread over the folds alike; missing features count as 180, the widest gap of hues."""
    by, a, b = key

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([a, b], ignore_index=True)
        y = pdf[label].to_numpy(bool)
        order = pdf["_order"].to_numpy()
        blob = pickle.dumps((pdf[a].to_numpy(np.int64), pdf[b].to_numpy(np.int64), binned(pdf[FEATURES].to_numpy(float, na_value=180.0)), y, stratified_folds(y, order, folds)))
        return pd.DataFrame({"by": [pdf["_by"].iloc[0]], "blob": [blob]})

    told = pairs.select(F.col(by).cast("string").alias("_by"), a, b, label, *FEATURES, F.xxhash64(F.lit(seed), *key).alias("_order"))
    rows = told.groupBy("_by").applyInPandas(packed, "by string, blob binary")
    tasks = rows.select("by", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "blob").select("by", "fold", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(block))).alias("first"), "blob")
    spread = tasks.repartition("by", "fold", "first").mapInArrow(_votes(trees, block, depth, leaf, seed), "by string, a bigint, b bigint, votes double")
    p = spread.groupBy("by", "a", "b").agg((F.sum("votes") / trees).alias("p"))
    found = p.select(F.col("by").alias("_by"), F.col("a").alias(a), F.col("b").alias(b), "p")
    return pairs.withColumn("_by", F.col(by).cast("string")).join(found, ["_by", a, b]).select(*pairs.columns, "p")


def zones_from(pairs: DataFrame, by: str, a: str, b: str, cut: float = 0.2) -> DataFrame:
    """(by, cluster, zone): complete linkage of each ``by``'s clusters on 1 - p; a pair that is not given is 1 apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[[a, b]].to_numpy())
        far = np.ones((len(ids), len(ids)))
        np.fill_diagonal(far, 0)
        i, j = np.searchsorted(ids, pdf[a]), np.searchsorted(ids, pdf[b])
        far[i, j] = far[j, i] = 1 - pdf["p"]
        return pd.DataFrame({by: pdf[by].iloc[0], "cluster": ids, "zone": nearest_chain_linkage(far, cut)})

    return pairs.select(by, a, b, "p").groupBy(by).applyInPandas(run, f"{by} string, cluster long, zone long")
