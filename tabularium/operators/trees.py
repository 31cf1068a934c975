"""Fitted trees as their leaves: for each the conditions, feature by feature, under which a row comes to it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Condition:
    """What one feature must be: above ``low``, not above ``high``, none of ``but``. NaN is above all."""

    feature: int
    low: float = -math.inf
    high: float = math.inf
    but: frozenset[float] = frozenset()

    def holds(self, x: np.ndarray) -> np.ndarray:
        met = ~(x <= self.low) if self.low > -math.inf else np.ones(len(x), bool)
        if self.high < math.inf:
            met &= x <= self.high
        for v in self.but:
            met &= x != v
        return met

    def above(self, t: float) -> Condition:
        return Condition(self.feature, max(self.low, t), self.high, self.but)

    def upto(self, t: float) -> Condition:
        return Condition(self.feature, self.low, min(self.high, t), self.but)

    def without(self, v: float) -> Condition:
        return Condition(self.feature, self.low, self.high, self.but | {v})


@dataclass(frozen=True)
class Leaf:
    """``value`` is what the leaf adds to the output (a class's margin); ``conditions`` has one of each feature on the way."""

    value: float
    conditions: tuple[Condition, ...]
    output: int = 0


@dataclass
class Split:
    """A node: rows whose feature is at most ``threshold`` go left; with ``level`` those whose feature is not that level do."""

    feature: int
    left: Split | float
    right: Split | float
    threshold: float = math.nan
    level: float | None = None


def leaves(root: Split | float, weight: float = 1.0, output: int = 0) -> list[Leaf]:
    """The leaves of a tree whose other ends are values."""
    out: list[Leaf] = []
    waiting: list[tuple[Split | float, dict[int, Condition]]] = [(root, {})]
    while waiting:
        node, conditions = waiting.pop()
        if not isinstance(node, Split):
            out.append(Leaf(weight * node, tuple(conditions[f] for f in sorted(conditions)), output))
            continue
        own = conditions.get(node.feature, Condition(node.feature))
        left, right = (own.upto(node.threshold), own.above(node.threshold)) if node.level is None else (own.without(node.level), own.above(node.level - 0.5).upto(node.level + 0.5))
        waiting += [(node.right, conditions | {node.feature: right}), (node.left, conditions | {node.feature: left})]
    return out


@dataclass
class Slots:
    """Which feature, and which of its levels, a place in an assembled vector stands for."""

    features: Sequence[str]
    wide: dict[str, int] = field(default_factory=dict)
    edges: dict[str, np.ndarray] = field(default_factory=dict)

    def end(self, feature: int, threshold: float) -> float:
        """A threshold between numbers of bins as the upper end of the last bin below it."""
        own = self.edges.get(self.features[feature])
        return threshold if own is None else float(own[math.floor(threshold)])

    def find(self, slot: int) -> tuple[int, float | None]:
        at = 0
        for k, c in enumerate(self.features):
            size = self.wide.get(c, 1)
            if slot < at + size:
                return k, float(slot - at) if c in self.wide else None
            at += size
        raise IndexError(slot)


def of_spark(tree, slots: Slots) -> Split | float:
    """The root of a decision tree of Spark ML; its size is bounded by the depth."""

    def built(node) -> Split | float:
        if "LeafNode" in node.getClass().getName():
            return float(node.prediction())
        split = node.split()
        feature, level = slots.find(int(split.featureIndex()))
        left, right = built(node.leftChild()), built(node.rightChild())
        if "Categorical" in split.getClass().getName():  # of a level that is there (1) or not (0)
            if 1.0 in list(split.leftCategories()):
                left, right = right, left
            threshold = 0.5
        else:
            threshold = float(split.threshold())
        if level is None:
            return Split(feature, left, right, slots.end(feature, threshold))
        return Split(feature, left, right, level=level)  # levels are 0 or 1, thresholds between them

    return built(tree._java_obj.rootNode())
