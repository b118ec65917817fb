"""k-hop neighbourhoods over directed edges: frontier joins of bounded depth, each hop written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import written


def k_hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(board_id, id, hop) of every node within `depth` edges of a seed; edges: board_id, src, dst; seeds: board_id, id.

    Nothing is truncated. A hub node's edges are spread by the join's shuffle on (board, src) and AQE's skew handling; what
    a hop reaches is made distinct map-side first."""
    edges = written(edges.select("board_id", "src", "dst").distinct(), "edges")
    seen = seeds.select("board_id", "id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select("board_id", F.col("id").alias("src")).join(edges, ["board_id", "src"]).select("board_id", F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(seen, ["board_id", "id"], "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        seen = seen.unionByName(frontier)
    return seen


def logged_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """The edges out of every node that is expanded, back edges included, as often as they stand."""
    return edges.join(reached.filter(F.col("hop") < depth).select("board_id", F.col("id").alias("src")), ["board_id", "src"], "left_semi")


def trace(edges: DataFrame, board: str, seeds: list[str], depth: int = 1, max_nodes: int = 250) -> tuple[list[str], bool, DataFrame]:
    """(nodes in the order they are met, whether nodes were left out, the edges out of all expanded nodes with their order): the
    breadth-first trace of one board, at most `max_nodes` nodes, seeds included.

    Level by level: the next nodes are the targets of the level's edges by where they come first. Spark finds those and
    sends as many as there is room for, and one more that tells whether any is left out; edges stay where they are."""
    own = edges.filter(F.col("board_id") == board)
    place = F.struct("_node", "net_ord", "net_id", "pin_ord", "edge_no")
    met, level, truncated, expanded = list(dict.fromkeys(seeds)), list(dict.fromkeys(seeds)), False, []
    for _ in range(depth):
        if not level:
            break
        expanded += level
        asked = own.sparkSession.createDataFrame(list(enumerate(level, len(expanded) - len(level))), "_node long, src string")
        new = own.join(asked, "src").filter(~F.col("dst").isin(met)).groupBy("dst").agg(F.min(place).alias("_p"))
        room = max(0, max_nodes - len(met))
        level = [r["dst"] for r in new.orderBy("_p").limit(room + 1).collect()]
        truncated |= len(level) > room
        level = level[:room]
        met += level
    nodes = own.sparkSession.createDataFrame(list(enumerate(expanded)), "_node long, src string")
    return met, truncated, own.join(nodes, "src").select(place.alias("place"), "src", "dst")
