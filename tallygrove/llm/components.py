"""Connected components of a link table, by rounds of hooking and contraction.

Each round every node hooks to its smallest neighbour if that is smaller than
itself.  Hooks make trees; they are followed to their roots by doubling, so a
chain of any length takes as many joins as its length has binary digits.  Then
links are rewritten between roots, and links inside one tree vanish.  The
smallest node of a component is always a root, so it is the label in the end.
Each step is a table in the shared folder, so a lost executor repeats tasks
only.  A node with many links, or a label of many nodes, is a hot key of the
left side of a join only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _roots(hooks: DataFrame) -> DataFrame:
    """node, label: where the hooks (node, label) of a forest lead in the end; roots hook to themselves."""
    while True:
        far = hooks.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = settle(hooks.join(far, hooks["label"] == far["mid"]).select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "steps")
        hooks = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): the smallest node reachable.  Nodes without links aren't listed; nulls are no nodes."""
    left = settle(links.select("a", "b").filter("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = _roots(settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "hooks"))
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step.select(F.col("node").alias(end), F.col("label").alias(f"new_{end}")), end)
        left = settle(left.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).filter("a <> b").distinct(), "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("label"), F.col("label").alias("later"))
        found = found.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label"))
    return found
