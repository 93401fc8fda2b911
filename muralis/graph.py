"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.storage import materialise, materialise_with

#: Edges that a task takes, so that the late, small rounds don't cost as many tasks as the first.
EDGES_PER_TASK = 50_000
LEAST_TASKS = 12
#: Nodes that a task remembers while it drops edges that join what is joined.
REMEMBERED = 1_000_000


def spanning(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) those that, task by task, join what is not joined yet; loops stay. Components are the same, and dense graphs shrink to about
    as many edges a task as it meets nodes. A task that has met very many nodes forgets them, and then keeps more edges than it need."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for batch in batches:
            if len(parent) > REMEMBERED:
                parent = {}
            kept = []
            for k, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = u, v
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[up]
                while (up := parent.setdefault(y, y)) != y:
                    parent[y] = y = parent[up]
                if x != y:
                    parent[y] = x
                    kept.append(k)
                elif u == v:
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return edges.mapInArrow(keep, edges.schema)


def connected_components(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """id, component (the smallest id it reaches) for every id in ``edges`` (a, b of one orderable type).

    Alternates two steps: link each node's larger neighbours to its smallest one, then its smaller neighbours to their
    smallest, until every edge joins a node to the smallest of its component. The number of rounds grows with the logarithm
    of the size of a component, not with its diameter, edges never multiply, and each round is written to the shared folder,
    which cuts the lineage and lets Spark split the joins at a node with very many neighbours. Loops and null ends are
    ignored, save that an id whose only edge is a loop is a component of its own.
    """
    spark = edges.sparkSession
    clean = edges.select("a", "b").filter("a is not null and b is not null")
    edges, facts = materialise_with(spanning(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "edges", n=F.count("*"), loops=F.count_if(F.col("u") == F.col("v")))
    tasks = max(LEAST_TASKS, facts["n"] // EDGES_PER_TASK)

    def sized(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    now = edges.filter("u <> v") if facts["loops"] else edges
    for _ in range(rounds):
        # Large step: every neighbour above u, to the smallest of u and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # A node is settled if all its neighbours are above it, or if it has one only.
        least, state = materialise_with(sized(least), "least", unsettled=F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1)))
        if not state["unsettled"]:
            break
        large = materialise(sized(both.join(least.select("u", F.least("u", "m").alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        # Small step: u and its smaller neighbours, to the smallest of them.
        least = materialise(sized(large.groupBy("u").agg(F.min("v").alias("m"))), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(sized(small), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = found.union(now.select("v", "v").distinct().toDF("id", "component"))
    if facts["loops"]:
        loops = edges.filter("u = v").select("u", "v").toDF("id", "component")
        found = found.union(loops.join(found.select("id"), "id", "left_anti"))
    return found
