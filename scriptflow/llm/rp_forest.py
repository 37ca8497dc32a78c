"""Random-projection trees: random splits at medians, fitted on a bounded sample, then refined within leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Vectors that fit the upper splits, at most; every vector is indexed.
SAMPLE = 16_384


@dataclass
class Tree:
    """A complete binary tree; node k has the children 2k+1 and 2k+2."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def route(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; rows within spill of a cut go to both sides."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[rows], self.directions[nodes]) - self.cuts[nodes]
            right, left = p > -spill, p <= spill
            if spill == 0:
                left = ~right
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes - ((1 << self.depth) - 1)


def fit(sample: np.ndarray, trees: int, depth: int, seed: int) -> list[Tree]:
    """Trees whose splits lie at the sample's medians. Without a sample, trees of one leaf."""
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        d = depth if len(sample) else 0
        directions = rng.standard_normal(((1 << d) - 1, sample.shape[1]))
        directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-30)
        cuts = np.zeros(len(directions))
        at = np.zeros(len(sample), np.int64)
        for level in range(d):
            p = np.einsum("ij,ij->i", sample, directions[at])
            order = np.lexsort((p, at))
            first = (1 << level) - 1
            bounds = np.searchsorted(at[order], np.arange(first, 2 * first + 2))
            for k in range(1 << level):
                if bounds[k + 1] > bounds[k]:
                    cuts[first + k] = np.median(p[order[bounds[k] : bounds[k + 1]]])
            at = 2 * at + 1 + (p > cuts[at])
        out.append(Tree(directions, cuts, d))
    return out


def leaves(x: np.ndarray, size: int, spill: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Splits rows further, within one task, until at most size are together or no split parts them."""
    todo = [np.arange(len(x))]
    while todo:
        idx = todo.pop()
        if len(idx) <= size:
            yield idx
            continue
        for _ in range(3):
            u = rng.standard_normal(x.shape[1])
            p = x[idx] @ (u / np.linalg.norm(u))
            cut = np.median(p)
            left, right = idx[p <= cut + spill], idx[p > cut - spill]
            if max(len(left), len(right)) <= 0.8 * len(idx):
                todo += [left, right]
                break
        else:
            yield idx
