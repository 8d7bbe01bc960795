"""A generative label model for binary voters of unknown accuracy, with correlations.

The class of an item is never seen. Each voter fires with a probability that depends on the class and, for
correlated voters, on one other voter: inside a class the voters form a tree. Expectation maximisation
estimates all of it from the agreement of the voters; the tree is the maximum spanning tree over the voters'
mutual information inside the classes (what the class does not explain).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    prior: float
    parents: list[int]
    #: rates[c, j, p]: chance that voter j fires in class c when its parent's vote is p
    rates: np.ndarray
    #: correlations[i, j]: mutual information of voters i and j inside the classes
    correlations: np.ndarray

    def accuracies(self, votes: np.ndarray) -> np.ndarray:
        """(share of class 1 that fires, share of class 0 that stays silent) of each voter, on these votes."""
        q = self.posterior(votes)[:, None]
        fires = lambda weight: (weight * votes).sum(0) / np.maximum(weight.sum(), 1e-9)
        return np.stack([fires(q), 1 - fires(1 - q)])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _posterior(votes, self.prior, self.parents, self.rates)


def _posterior(votes, prior, parents, rates):
    n, m = votes.shape
    given = np.stack([np.zeros(n, int) if p < 0 else votes[:, p].astype(int) for p in parents], 1)
    log = np.empty((2, n))
    for c in (0, 1):
        r = rates[c, np.arange(m)[None, :], given]
        log[c] = np.log(np.where(votes > 0, r, 1 - r)).sum(1)
    gap = log[1] - log[0] + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _rates(votes, q, parents):
    m = votes.shape[1]
    out = np.empty((2, m, 2))
    for c, weight in ((0, 1 - q), (1, q)):
        for j, p in enumerate(parents):
            for value in (0, 1):
                w = weight if p < 0 else weight * (votes[:, p] == value)
                # a rate from few items leans towards the voter's rate in its class
                base = ((weight * votes[:, j]).sum() + 0.5) / (weight.sum() + 1)
                out[c, j, value] = ((w * votes[:, j]).sum() + 4 * base) / (w.sum() + 4)
    return np.clip(out, 1e-6, 1 - 1e-6)


def _information(votes, q):
    """Mutual information of every two voters inside the classes, averaged over the classes."""
    m = votes.shape[1]
    out = np.zeros((m, m))
    for weight in (1 - q, q):
        total = weight.sum()
        if total <= 0:
            continue
        both = (votes * weight[:, None]).T @ votes / total
        one = np.diag(both)
        for x in (0, 1):
            for y in (0, 1):
                a = one if x else 1 - one
                b = one if y else 1 - one
                joint = both if x and y else (one[:, None] - both if x else (one[None, :] - both if y else 1 - one[:, None] - one[None, :] + both))
                ratio = np.maximum(joint, 1e-12) / np.maximum(a[:, None] * b[None, :], 1e-12)
                out += total / len(q) * np.maximum(joint, 0) * np.log(ratio)
    np.fill_diagonal(out, 0)
    return np.maximum(out, 0)


def _tree(strength, least):
    """Parents of a maximum spanning forest; links weaker than ``least`` are left out."""
    m = len(strength)
    parents, inside = [-1] * m, {0} if m else set()
    while len(inside) < m:
        gain, j, p = max((strength[p, j], -j, p) for p in inside for j in range(m) if j not in inside)
        j = -j
        parents[j] = p if gain >= least else -1
        inside.add(j)
    return parents


def fit(votes: np.ndarray, start: np.ndarray, rounds: int = 300) -> LabelModel:
    """``votes[i, j]`` in {0, 1}: voter j fires on item i. ``start``: first guess of each item's chance of class 1,
    which fixes the meaning of the classes. No items give a model with equal chances."""
    n, m = votes.shape
    parents = [-1] * m
    if not n:
        return LabelModel(0.5, parents, np.full((2, m, 2), 0.5), np.zeros((m, m)))
    q = start
    strength = np.zeros((m, m))
    for tree in (False, True):
        if tree:
            strength = _information(votes, q)
            parents = _tree(strength, 2 / n)
        for _ in range(rounds):
            rates = _rates(votes, q, parents)
            prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
            before, q = q, _posterior(votes, prior, parents, rates)
            if np.abs(q - before).max() < 1e-4:
                break
    return LabelModel(prior, parents, rates, strength)
