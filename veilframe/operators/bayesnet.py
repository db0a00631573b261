"""Differentially private synthesis by a tree Bayesian network.

Spark counts every pair of attributes in one job; the tree of at most some dozens of nodes is found on the
driver; noisy tables and sampling are Spark plans again. The budget covers the tables' counts only:
the tree and the categories come from the data as they are, so the promise holds for those counts alone. noisy_structure
perturbs the mutual information as well.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.determinism import entropy, fresh_salt, uniform
from ..functions.numeric import laplace
from .sampling import categorical_draw, cumulative, grid_cell, on_grid
from .stats import contingency, mutual_information, value_counts


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of a breadth-first walk, and each one's parent (None for the root)."""

    order: tuple[str, ...]
    parent: dict[str, str | None] = field(default_factory=dict)
    weight: dict[tuple[str, str], float] = field(default_factory=dict)

    def edges(self) -> list[tuple[str, str, float, int]]:
        """(parent, child, weight, level)."""
        level = {self.order[0]: 0} if self.order else {}
        out = []
        for node in self.order[1:]:
            p = self.parent[node]
            level[node] = level[p] + 1
            out.append((p, node, self.weight.get((min(p, node), max(p, node)), 0.0), level[node]))
        return out


def spanning_tree(nodes: list[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Edges of the maximum spanning tree; equal weights by name."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    chosen = []
    for (a, b), _ in sorted(weights.items(), key=lambda e: (-e[1], e[0])):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            chosen.append((a, b))
    return chosen


def orient(nodes: list[str], edges: list[tuple[str, str]], weights: dict[tuple[str, str], float] | None = None) -> Tree:
    """A breadth-first walk from the node of the largest degree, the first by name among equals."""
    near: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    if not nodes:
        return Tree(())
    start = min(nodes, key=lambda n: (-len(near[n]), n))
    parent: dict[str, str | None] = {start: None}
    queue = deque([start])
    while queue:
        node = queue.popleft()
        for other in sorted(near[node]):
            if other not in parent:
                parent[other] = node
                queue.append(other)
    return Tree(tuple(parent), parent, dict(weights or {}))


def chow_liu(df: DataFrame, columns: list[str], noisy_structure: float | None = None) -> Tree:
    """The tree of largest mutual information; with noisy_structure, after Laplace noise of that scale on each pair."""
    weights = {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["mi"] for r in mutual_information(df, columns).collect()}
    if noisy_structure:
        weights = {pair: mi + entropy_laplace(noisy_structure) for pair, mi in weights.items()}
    return orient(columns, spanning_tree(columns, weights), weights)


def node_budgets(tree: Tree, epsilon: float) -> dict[str, float]:
    """Half for the root, the other half shared by the rest; all for a single node."""
    n = len(tree.order)
    return {c: epsilon if n == 1 else epsilon / 2 if i == 0 else epsilon / (2 * (n - 1)) for i, c in enumerate(tree.order)}


Draw = Callable[[str, Column], Column]
#: Adds the cells' noise: (node, cells, name of the cell, scale) to cells with a column noise.
Noise = Callable[[str, DataFrame, Column, float], DataFrame]


def entropy_laplace(scale: float) -> float:
    d = entropy() - 0.5
    return -scale * math.copysign(math.log(max(1 - 2 * abs(d), 1e-300)), d)


def seeded_noise(seed: int | str) -> Noise:
    """Uniforms by node and cell: for tests."""
    return lambda node, cells, cell, scale: cells.withColumn("noise", laplace(uniform(f"{seed}|{node}", cell), scale))


def entropy_noise(node: str, cells: DataFrame, cell: Column, scale: float) -> DataFrame:
    """Noise drawn once per cell on the driver, where the released tables go anyway: no plan holds what it came from."""
    rows = [(*r, entropy_laplace(scale)) for r in cells.collect()]
    return cells.sparkSession.createDataFrame(rows, StructType([*cells.schema.fields, StructField("noise", DoubleType())]))


def noisy_marginal(df: DataFrame, node: str, epsilon: float, noise: Noise) -> DataFrame:
    """(parent_value, value, prob) of the root: counts with noise, held to 0 or more, normalised; uniform if nothing is left."""
    counts = noise(node, value_counts(df, node), F.col("value"), 1.0 / epsilon)
    noisy = counts.withColumn("c", F.greatest(F.lit(0.0), F.col("n") + F.col("noise")))
    sums = noisy.agg(F.sum("c").alias("total"), F.count("*").alias("cells"))
    prob = F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(F.lit(1.0) / F.col("cells"))
    return noisy.join(sums, how="cross").select(F.lit(None).cast("string").alias("parent_value"), "value", prob.alias("prob"))


def noisy_conditional(df: DataFrame, parent: str, node: str, epsilon: float, noise: Noise) -> DataFrame:
    """(parent_value, value, prob) over the full grid of observed values, empty cells with noise as well."""
    cells = noise(node, contingency(df, parent, node), F.concat_ws("|", "parent", "child"), 1.0 / epsilon)
    noisy = cells.withColumn("c", F.greatest(F.lit(0.0), F.col("n") + F.col("noise")))
    row = Window.partitionBy("parent")
    total = F.sum("c").over(row)
    return noisy.select(
        F.col("parent").alias("parent_value"), F.col("child").alias("value"),
        F.when(total > 0, F.col("c") / total).otherwise(F.lit(1.0) / F.count("*").over(row)).alias("prob")
    )


def conditional_tables(df: DataFrame, tree: Tree, epsilon: float, noise: Noise = entropy_noise) -> DataFrame:
    """(node, parent_value, value, prob, lo, hi) of all nodes."""
    budgets, out = node_budgets(tree, epsilon), None
    for node in tree.order:
        parent = tree.parent[node]
        table = noisy_marginal(df, node, budgets[node], noise) if parent is None else noisy_conditional(df, parent, node, budgets[node], noise)
        table = cumulative(table, "value", "prob", "parent_value").select(
            F.lit(node).alias("node"), "parent_value", "value", "prob", "lo", "hi"
        )
        out = table if out is None else out.unionByName(table)
    return out


def ancestral_sample(rows: DataFrame, key: str, tree: Tree, tables: DataFrame, draw: Draw) -> DataFrame:
    """rows(key) with a value per node, parents first. draw gives a node's uniform by row."""
    for node in tree.order:
        mine = tables.where(F.col("node") == node)
        parent = tree.parent[node]
        u = draw(node, F.col(key))
        if parent is None:
            rows = categorical_draw(rows, u, mine, "value", node)
        else:
            table = mine.select(
                F.col("parent_value").alias("__p"), F.col("value").alias(node), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")
            )
            same = (F.col(parent) == F.col("__p")) & (F.col("__cell") == F.col("__at"))
            drawn = rows.withColumns({"__u": u, "__cell": grid_cell(u)}).join(
                on_grid(table, "__lo", "__hi", "__at"), same & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
            )
            rows = drawn.drop("__u", "__cell", "__at", "__p", "__lo", "__hi")
    return rows


class PrivBayes:
    """fit(df, columns), then sample(n)."""

    def __init__(self, epsilon: float = 1.0, seed: int | None = None, noisy_structure: float | None = None):
        self.epsilon, self.seed, self.noisy_structure = epsilon, seed, noisy_structure

    def fit(self, df: DataFrame, columns: list[str]) -> PrivBayes:
        self.columns = columns
        counted = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
        self.tree = chow_liu(counted, columns, self.noisy_structure)
        noise = entropy_noise if self.seed is None else seeded_noise(self.seed)
        tables = conditional_tables(counted, self.tree, self.epsilon, noise)
        # the released model: as many rows as cells, kept on the driver so that its noise is drawn once
        self.model = [tuple(r) for r in tables.collect()]
        self.schema = tables.schema
        self.spark = df.sparkSession
        return self

    @property
    def tables(self) -> DataFrame:
        return self.spark.createDataFrame(self.model, self.schema)

    def sample(self, n: int, tree_order: bool = False) -> DataFrame:
        """n rows in the columns' order, or in the order of the walk."""
        rows = self.spark.range(n).withColumnRenamed("id", "__row")
        # draws only process the released tables, so they cost no privacy and may stand in a plan
        salt = fresh_salt() if self.seed is None else self.seed
        draw = lambda node, key: uniform(f"{salt}|draw|{node}", key)
        out = ancestral_sample(rows, "__row", self.tree, self.tables, draw)
        return out.select(*(self.tree.order if tree_order else self.columns))
