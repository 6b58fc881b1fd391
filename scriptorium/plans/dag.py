"""Pipeline graphs: expansion of pools, levels, cycles. One plan, with its few nodes, is handled on the driver; tables of plans by a recursive query."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.tables import stored


@dataclass(frozen=True)
class Node:
    name: str
    dependencies: tuple[str, ...] = ()
    pool_size: int = 1


def expand_pools(nodes: list[Node]) -> list[Node]:
    """A node with a pool becomes ``name_pool_i`` for each instance; those that depend on it depend on all."""
    names = {n.name: [f"{n.name}_pool_{i}" for i in range(n.pool_size)] if n.pool_size > 1 else [n.name] for n in nodes}
    return [replace(n, name=name, pool_size=1, dependencies=tuple(x for d in n.dependencies for x in names.get(d, [d]))) for n in nodes for name in names[n.name]]


def levels(nodes: list[Node]) -> list[list[str]]:
    """Names by level, each after all its dependencies; ValueError for a cycle or an unknown dependency."""
    known = {n.name for n in nodes}
    if unknown := {d for n in nodes for d in n.dependencies} - known:
        raise ValueError(f"unknown dependencies: {sorted(unknown)}")
    done: set[str] = set()
    out: list[list[str]] = []
    while len(done) < len(known):
        ready = [n.name for n in nodes if n.name not in done and done.issuperset(n.dependencies)]
        if not ready:
            raise ValueError(f"cycle among {sorted(known - done)}")
        out.append(ready)
        done.update(ready)
    return out


def level_table(nodes: DataFrame, edges: DataFrame, plan: str, most: int = 64) -> DataFrame:
    """(plan, node, level) of many plans at once, out of tables: ``nodes`` (plan, node) and ``edges`` (plan, node, dependency).

    A recursive query walks from the nodes without dependencies; a node's level is its longest way. ValueError for an unknown
    dependency, a cycle, or a way of more than ``most`` steps. It walks every way, so it suits plans, whose nodes have few.
    """
    spark = nodes.sparkSession
    nodes, edges = nodes.select(F.col(plan).alias("plan"), "node").distinct(), edges.select(F.col(plan).alias("plan"), "node", "dependency").distinct()
    unknown = edges.join(nodes.withColumnRenamed("node", "dependency"), ["plan", "dependency"], "left_anti")
    if row := unknown.first():
        raise ValueError(f"unknown dependency {row['dependency']!r} in plan {row['plan']!r}")
    sql = f"""WITH RECURSIVE walk(plan, node, level) MAX RECURSION LEVEL {most + 3} AS (
      SELECT n.plan, n.node, 0 FROM {{nodes}} n LEFT ANTI JOIN {{edges}} e ON n.plan <=> e.plan AND n.node = e.node
      UNION ALL SELECT e.plan, e.node, w.level + 1 FROM walk w JOIN {{edges}} e ON e.plan <=> w.plan AND e.dependency = w.node WHERE w.level <= {most}
    ) SELECT plan, node, max(level) AS level FROM walk GROUP BY plan, node"""
    found = stored(spark.sql(sql, nodes=nodes, edges=edges), "levels")
    # Nodes that no way reaches, or one that never ends.
    stuck = nodes.join(found.filter(F.col("level") <= most), ["plan", "node"], "left_anti")
    if row := stuck.first():
        raise ValueError(f"cycle, or a way of more than {most} steps, in plan {row['plan']!r} at {row['node']!r}")
    return found.withColumnRenamed("plan", plan)
