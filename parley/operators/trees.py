"""Fitted boosted trees as plain expressions: one SQL text that Spark and other engines run alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.calibrate import platt_apply

#: A leaf's value, or (feature, threshold, subtree at or below it, subtree above it).
Node = float | tuple
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def _number(x: float) -> str:
    """A double in any SQL: 0.5 alone would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _sum(terms: list[str]) -> str:
    """A balanced sum, so that hundreds of terms nest a few levels only."""
    if len(terms) < 2:
        return terms[0] if terms else "0e0"
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})"


@dataclass(frozen=True)
class Ensemble:
    """Weighted regression trees over named features; the log-odds of y = 1 are ``scale`` times the sum of all of them."""

    trees: tuple[tuple[float, Node], ...]
    scale: float = 2.0

    def first(self, n: int) -> Ensemble:
        return Ensemble(self.trees[:n], self.scale)

    def steps(self) -> list[str]:
        """What each tree adds to the log-odds, as SQL."""

        def text(node: Node, weight: float) -> str:
            if isinstance(node, tuple):
                return f"CASE WHEN {node[0]} <= {_number(node[1])} THEN {text(node[2], weight)} ELSE {text(node[3], weight)} END"
            return _number(node * weight)

        return [text(node, weight * self.scale) for weight, node in self.trees]

    def sql(self) -> str:
        """The log-odds as SQL."""
        return _sum(self.steps())

    def raw(self) -> Column:
        """The log-odds as a column: conditionals only, no function of Python's and no vectors."""
        return F.expr(self.sql())

    def staged(self) -> Column:
        """An array of what each tree adds, whose prefix sums are the log-odds after each round."""
        return F.expr(f"array({', '.join(self.steps())})") if self.trees else F.array().cast("array<double>")


def compiled(model: PipelineModel) -> Ensemble:
    """The trees of a model that ``train_gbt`` has fitted."""
    assembler, gbt = model.stages
    names = assembler.getInputCols()
    trees, lines = [], iter(gbt.toDebugString.splitlines()[1:])

    def node(line: str) -> Node:
        if line.startswith("Predict: "):
            return float(line[9:])
        m = _SPLIT.match(line)
        if m is None:
            raise ValueError(f"not a split by a threshold: {line}")
        below = node(next(lines).strip())
        next(lines)  # the other side of the same split
        return names[int(m[1])], float(m[2]), below, node(next(lines).strip())

    for line in lines:
        if line.strip().startswith("Tree "):
            trees.append((float(line.partition("weight ")[2].rstrip("):")), node(next(lines).strip())))
    return Ensemble(tuple(trees))


def score_model(rows: DataFrame, ensemble: Ensemble, a: float = -1.0, b: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """``rows`` with raw (log-odds), p (after Platt's a and b), is_synthetic (p at or above the threshold) and confidence (the chance of the verdict).

    With a = -1 and b = 0, p is the model's own chance of y = 1.
    """
    told = rows.withColumn("raw", ensemble.raw())
    told = told.withColumn("p", platt_apply(F.col("raw"), a, b)).withColumn("is_synthetic", F.col("p") >= threshold)
    return told.withColumn("confidence", F.when(F.col("is_synthetic"), F.col("p")).otherwise(1 - F.col("p")))
