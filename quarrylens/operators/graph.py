"""Call graphs: neighbours, bounded breadth-first search, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.scratch import settle

NODE = ["module", "func"]


def one_hop(edges: DataFrame, module: str, func: str) -> DataFrame:
    """Callees and callers of one function: side, module, func; links are not deduplicated."""
    down = edges.where((F.col("caller_module") == module) & (F.col("caller_func") == func)).select(F.lit("callee").alias("side"), F.col("callee_module").alias("module"), F.col("callee_func").alias("func"))
    up = edges.where((F.col("callee_module") == module) & (F.col("callee_func") == func)).select(F.lit("caller").alias("side"), F.col("caller_module").alias("module"), F.col("caller_func").alias("func"))
    return down.union(up)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (module, func)."""
    a = nodes.select(F.col("module").alias("caller_module"), F.col("func").alias("caller_func")).distinct()
    b = nodes.select(F.col("module").alias("callee_module"), F.col("func").alias("callee_func")).distinct()
    return edges.join(a, ["caller_module", "caller_func"], "left_semi").join(b, ["callee_module", "callee_func"], "left_semi")


def module_relations(edges: DataFrame) -> DataFrame:
    """Distinct module pairs of cross-package calls, none to itself."""
    return edges.where("call_kind = 2 and caller_module <> callee_module").select(F.col("caller_module").alias("from_module"), F.col("callee_module").alias("to_module")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """Functions reached from seeds (module, func) in at most max_depth calls: module, func, depth, caller and callee of the edge that reached it first.

    Seeds are not in the result and cycles end.  Of several edges that reach a function at its
    least depth the least in text order is named.  A level is one join of the frontier with the
    edges and one anti join with what has been seen.
    """
    near, far = ("callee", "caller") if reverse else ("caller", "callee")
    links = edges.select(
        F.col(f"{near}_module").alias("from_m"), F.col(f"{near}_func").alias("from_f"), F.col(f"{far}_module").alias("module"), F.col(f"{far}_func").alias("func"),
        F.concat_ws(".", "caller_module", "caller_func").alias("caller"), F.concat_ws(".", "callee_module", "callee_func").alias("callee"),
    )
    seen = frontier = seeds.select(*NODE).distinct()
    found = None
    for depth in range(1, max_depth + 1):
        start = frontier.select(F.col("module").alias("from_m"), F.col("func").alias("from_f"))
        level = links.join(start, ["from_m", "from_f"], "left_semi").join(seen, NODE, "left_anti")
        level = level.groupBy(*NODE).agg(F.min(F.struct("caller", "callee")).alias("edge")).select(*NODE, F.lit(depth).alias("depth"), "edge.caller", "edge.callee")
        if depth < max_depth:
            level = settle(level, "bfs-level")
            frontier = level.select(*NODE)
            seen = seen.union(frontier)
        found = level if found is None else found.union(level)
    return found


def impact(edges: DataFrame, seeds: DataFrame, direction: str = "both", max_depth: int = 2) -> DataFrame:
    """bfs either way or both, with kind reverse (upstream) or forward (downstream)."""
    if direction not in ("both", "up", "down"):
        raise ValueError(f"direction {direction!r}: both, up or down")
    parts = []
    if direction != "down":
        parts.append(bfs(edges, seeds, max_depth, reverse=True).withColumn("kind", F.lit("reverse")))
    if direction != "up":
        parts.append(bfs(edges, seeds, max_depth).withColumn("kind", F.lit("forward")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def impact_nodes(seeds: DataFrame, impacted: DataFrame) -> DataFrame:
    """One row for each function: changed wins over reverse, reverse over forward."""
    changed = seeds.select(*NODE, F.lit(0).alias("rank"), F.lit(0).alias("depth"))
    others = impacted.select(*NODE, F.when(F.col("kind") == "reverse", 1).otherwise(2).alias("rank"), "depth")
    best = changed.unionByName(others).groupBy(*NODE).agg(F.min(F.struct("rank", "depth")).alias("b"))
    return best.select(*NODE, F.when(F.col("b.rank") == 0, "changed").when(F.col("b.rank") == 1, "reverse").otherwise("forward").alias("kind"), F.col("b.depth").alias("depth"))
