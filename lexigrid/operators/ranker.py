"""Rankers of analyses within their words: boosted trees and linear models over pairs, trained on a bounded sample on the driver.

The sample's bound is a parameter of the callers; scoring runs on all rows in batches (operators.trees).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from lexigrid.operators.trees import Tree, evaluate


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper borders of a feature's cells: all values but the first if they are few, else the values at equal places of the sorted ones."""
    distinct = np.unique(x)
    if len(distinct) <= bins:
        return distinct[1:]
    ordered = np.sort(x)
    return np.unique([ordered[len(x) * q // bins] for q in range(1, bins)])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def pairs_of(labels: np.ndarray, groups: np.ndarray, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (better, worse) within each group, at most most worse ones for each better row."""
    better, worse = [], []
    order = np.argsort(groups, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        for i in rows[labels[rows] > 0]:
            low = rows[labels[rows] < labels[i]]
            if len(low) > most:
                low = rng.choice(low, most, replace=False)
            better.append(np.full(len(low), i))
            worse.append(low)
    return (np.concatenate(better), np.concatenate(worse)) if better else (np.empty(0, int), np.empty(0, int))


@dataclass(frozen=True)
class Boosting:
    """Settings of the boosted trees."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    shrink: float = 1.0
    least: int = 5
    rows: float = 0.8
    features: float = 0.8
    negatives: int = 10
    seed: int = 1


def _grow(b: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, use: np.ndarray, names: list[str], edges: list[np.ndarray], s: Boosting, depth: int) -> Tree:
    """A tree of Newton leaves over histograms of the cells; thresholds are raw values, x < thr goes left."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-9, -1, -1)
    if depth < s.depth and len(rows) >= 2 * s.least:
        for j in use:
            cells = len(edges[j]) + 1
            gs, hs = np.bincount(b[rows, j], grad[rows], cells).cumsum()[:-1], np.bincount(b[rows, j], hess[rows], cells).cumsum()[:-1]
            ns = np.bincount(b[rows, j], minlength=cells).cumsum()[:-1]
            gain = gs**2 / (hs + s.shrink) + (g - gs) ** 2 / (h - hs + s.shrink) - g**2 / (h + s.shrink)
            gain[(ns < s.least) | (len(rows) - ns < s.least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
    if best[1] < 0:
        return float(-g / (h + s.shrink))
    _, j, cut = best
    left = b[rows, j] <= cut
    sides = [_grow(b, grad, hess, rows[side], use, names, edges, s, depth + 1) for side in (left, ~left)]
    return {"feat": names[j], "thr": float(edges[j][cut]), "left": sides[0], "right": sides[1]}


def train_trees(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, names: list[str], settings: Boosting = Boosting()) -> list[Tree]:
    """Trees for scores by which rows with higher labels come first in their group: gradients of the logistic loss over pairs within groups. Without a
    pair there is no tree. Features must have no missing value.
    """
    rng = np.random.default_rng(settings.seed)
    better, worse = pairs_of(labels, groups, settings.negatives, rng)
    if not len(better):
        return []
    edges = [edges_of(x[:, j], settings.bins) for j in range(x.shape[1])]
    b, score, trees = binned(x, edges), np.zeros(len(x)), []
    columns = {n: x[:, j] for j, n in enumerate(names)}
    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(score[better] - score[worse]))
        grad, hess = np.zeros(len(x)), np.zeros(len(x))
        np.add.at(grad, better, -p)
        np.add.at(grad, worse, p)
        np.add.at(hess, better, p * (1 - p))
        np.add.at(hess, worse, p * (1 - p))
        rows = np.flatnonzero(rng.random(len(x)) < settings.rows)
        use = np.flatnonzero(rng.random(x.shape[1]) < settings.features)
        tree = _grow(b, grad, hess, rows, use, names, edges, settings, 0)
        score += settings.rate * evaluate(tree, columns, len(x))
        trees.append(tree)
    return trees


def train_linear(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, listwise: bool = False, steps: int = 200, rate: float = 0.1, decay: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights on standardised features: pairwise logistic loss, or listwise the cross-entropy of each group's softmax with its best rows."""
    mean, spread = x.mean(0), x.std(0)
    z = (x - mean) / np.where(spread > 0, spread, 1)
    w = np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    better, worse = pairs_of(labels, groups, 10, rng)
    _, of = np.unique(groups, return_inverse=True)
    top = np.zeros(of.max() + 1 if len(of) else 0)
    np.maximum.at(top, of, labels)
    gold = (labels == top[of]) & (labels > 0)
    n_gold = np.bincount(of, gold, len(top))
    for _ in range(steps):
        if listwise:
            s = z @ w
            peak = np.full(len(top), -np.inf)
            np.maximum.at(peak, of, s)
            e = np.exp(s - peak[of])
            soft = e / np.bincount(of, e, len(top))[of]
            has = n_gold[of] > 0
            grad = z.T @ (has * (soft - gold / np.maximum(n_gold[of], 1))) / max(len(top), 1)
        else:
            if not len(better):
                break
            d = z[better] - z[worse]
            grad = -(d.T @ (1 / (1 + np.exp(d @ w)))) / len(d)
        w -= rate * (grad + decay * w)
    return w / np.where(spread > 0, spread, 1)


def scores_of(trees: list[Tree], x: np.ndarray, names: list[str], rate: float) -> np.ndarray:
    columns = {n: x[:, j] for j, n in enumerate(names)}
    return rate * sum((evaluate(t, columns, len(x)) for t in trees), np.zeros(len(x)))


def hits_at_1(score: np.ndarray, labels: np.ndarray, groups: np.ndarray) -> tuple[int, int]:
    """Groups whose first row by score (the earlier of equals) has the highest label, and groups with a positive label."""
    hits = total = 0
    order = np.argsort(groups, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(order) else []:
        if labels[rows].max() > 0:
            total += 1
            hits += int(labels[rows[np.argmax(score[rows])]] == labels[rows].max())
    return hits, total


def nested_validation(x: np.ndarray, labels: np.ndarray, groups: np.ndarray, names: list[str], grid: list[Boosting], outer: int = 5, inner: int = 3, seed: int = 1) -> list[dict]:
    """For each outer fold of groups: the settings of grid that do best over the inner folds, and the hits with them on the fold."""
    ids = np.unique(groups)
    fold = dict(zip(np.random.default_rng(seed).permutation(ids).tolist(), (k % outer for k in range(len(ids))), strict=True))
    of = np.array([fold[g] for g in groups.tolist()])
    out = []
    for k in range(outer):
        train, test = np.flatnonzero(of != k), np.flatnonzero(of == k)
        inner_of = np.array([hash((g, seed)) % inner for g in groups[train].tolist()])
        def quality(s: Boosting) -> float:
            got = [0, 0]
            for i in range(inner):
                a, b = train[inner_of != i], train[inner_of == i]
                trees = train_trees(x[a], labels[a], groups[a], names, s)
                h = hits_at_1(scores_of(trees, x[b], names, s.rate), labels[b], groups[b])
                got = [got[0] + h[0], got[1] + h[1]]
            return got[0] / max(got[1], 1)

        best = grid[0] if len(grid) == 1 else max(grid, key=quality)
        trees = train_trees(x[train], labels[train], groups[train], names, best)
        hits, total = hits_at_1(scores_of(trees, x[test], names, best.rate), labels[test], groups[test])
        out.append({"fold": k, "depth": best.depth, "rounds": best.rounds, "hits": hits, "words": total})
    return out


def write_model(trees: list[Tree], names: list[str], rate: float) -> str:
    return json.dumps({"features": names, "learning_rate": rate, "trees": trees})


def read_model(text: str, expected: list[str]) -> tuple[list[Tree], float]:
    """Trees and rate of a model's text; its features must be those expected, in their order."""
    model = json.loads(text)
    if model["features"] != expected:
        raise ValueError("the model was made for other features")

    def checked(t: Tree) -> Tree:
        if isinstance(t, dict):
            if t.keys() != {"feat", "thr", "left", "right"} or t["feat"] not in expected:
                raise ValueError("no tree")
            return {**t, "left": checked(t["left"]), "right": checked(t["right"])}
        return float(t)

    return [checked(t) for t in model["trees"]], float(model["learning_rate"])
