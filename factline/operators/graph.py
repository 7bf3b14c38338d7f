"""Bounded traversal of the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of edges, most telling first; others come last.
EDGE_CLASSES = (
    ("calls", "framework_calls", "framework_object_call", "provided_by", "cross_resource_event", "cross_resource_callback", "cross_resource_export"),
    ("triggers", "handles", "registers", "uses_export", "defines"),
    ("references",),
    ("imports",),
)


def edge_class(kind: Column) -> Column:
    out = F.when(kind.isin(*EDGE_CLASSES[0]), 0)
    for k, names in enumerate(EDGE_CLASSES[1:], 1):
        out = out.when(kind.isin(*names), k)
    return out.otherwise(len(EDGE_CLASSES))


def ranked(edge: DataFrame | None = None) -> list[Column]:
    """Order of edges: class, static first, resolved first, surer first, id."""
    c = (lambda n: edge[n]) if edge is not None else F.col
    return [edge_class(c("kind")), c("dynamic").cast("int"), c("to_id").isNull().cast("int"), c("confidence").desc(), c("edge_id")]


MOST_RESULTS, MOST_SEEDS, MOST_EXPANDED = 200, 32, 256
STEP = "seed int, place int, edge_id string, from_id string, to_id string, kind string, dynamic boolean, confidence double, depth int, truncated boolean"


def walk(edges_at, seeds: list[str], depth: int = 2, direction: str = "outgoing", kinds: tuple[str, ...] = (), k: int = 50, by_rank: bool = False) -> DataFrame:
    """Breadth-first walks from up to ``MOST_SEEDS`` nodes, each bounded by ``k`` edges: (seed, place, edge..., depth, truncated).

    Nodes are taken in the order in which they are met, their edges by id or, ``by_rank``, by ``ranked``; a walk stops at
    the edge after the k-th, which tells that it is truncated.  Edges between nodes already met count, and a walk in both
    directions meets such an edge from either end.  ``edges_at(ids, direction)`` gives the edges at some nodes that have
    both endpoints.  A level leaves Spark as at most k + 1 edges a seed, so the next frontier is a short list of keys that
    reaches the scans as a filter."""
    depth, k = max(1, min(3, depth or 2)), max(1, min(MOST_RESULTS, k))
    if len(seeds) > MOST_SEEDS:
        raise ValueError(f"at most {MOST_SEEDS} seeds")
    met = [{s} for s in seeds]
    found: list[list[tuple]] = [[] for _ in seeds]
    front = [(i, 0, s) for i, s in enumerate(seeds)]
    spark = None
    for level in range(1, depth + 1):
        if not front:
            break
        edges = edges_at(sorted({n for _, _, n in front}), direction)
        spark = edges.sparkSession
        if kinds:
            edges = edges.filter(F.col("kind").isin(*kinds))
        ends = {"outgoing": ["from_id"], "incoming": ["to_id"], "both": ["from_id", "to_id"]}[direction]
        at = F.explode(F.array_distinct(F.array(*ends)))
        rows = edges.withColumn("_near", at).join(F.broadcast(spark.createDataFrame(front, "seed int, _pos int, _near string")), "_near")  # at most MOST_SEEDS * k rows
        order = Window.partitionBy("seed").orderBy("_pos", *(ranked() if by_rank else [F.col("edge_id")]))
        rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
        front = []
        for r in sorted(rows.collect(), key=lambda r: (r["seed"], r["_n"])):
            out = found[r["seed"]]
            if len(out) > k:
                continue
            out.append((r["edge_id"], r["from_id"], r["to_id"], r["kind"], r["dynamic"], r["confidence"], level))
            far = r["from_id"] if direction == "incoming" or (direction == "both" and r["to_id"] == r["_near"]) else r["to_id"]
            if far not in met[r["seed"]]:
                met[r["seed"]].add(far)
                front.append((r["seed"], len(front), far))
        front = [(i, p, n) for i, p, n in front if len(found[i]) <= k]
    rows = [(i, n, *e, len(out) > k) for i, out in enumerate(found) for n, e in enumerate(out[:k], 1)]
    return spark.createDataFrame(rows, STEP)


def expanded(edges_at, seeds: list[str], depth: int, direction: str) -> DataFrame:
    """Ranked walks from seeds in their order, each of a hundred edges at most, until ``MOST_EXPANDED`` edges in all."""
    out = walk(edges_at, seeds[:MOST_SEEDS], depth, direction, (), 100, True)
    return out.orderBy("seed", "place").limit(MOST_EXPANDED)
