"""Builds of the graph from triples: from scratch, or onto a saved one from files that changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import graph


@dataclass
class Built:
    """entities, edges (inferred ones marked, weights decayed), snapshots of neighbours, and drifted entities."""

    entities: DataFrame
    edges: DataFrame
    snapshots: DataFrame
    drifted: DataFrame


def reinforced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, dst, relation, weight, reinforcement_count) of a saved graph and of new triples' edges together.

    A pair that was known keeps its relation and gains 0.1 for each new triple, up to 1; a file that is read again
    reinforces again.
    """
    o = old.select("src", "dst", F.struct("relation", "weight", "reinforcement_count").alias("o"))
    n = new.select("src", "dst", F.struct("relation", "weight", "reinforcement_count").alias("n"))
    both = o.join(n, ["src", "dst"], "full")
    more = F.col("n.reinforcement_count") + 1
    known, fresh = F.col("o").isNotNull(), F.col("n").isNotNull()
    return both.select(
        "src", "dst", F.coalesce("o.relation", "n.relation").alias("relation"),
        F.when(known & fresh, F.least(F.lit(1.0), F.col("o.weight") + graph.REINFORCE * more)).when(known, F.col("o.weight")).otherwise(F.col("n.weight")).alias("weight"),
        F.when(known & fresh, F.col("o.reinforcement_count") + more).otherwise(F.coalesce("o.reinforcement_count", "n.reinforcement_count")).alias("reinforcement_count"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (name, type, mention_count) of a saved graph and of new triples together; the saved type stays."""
    o, n = old.select("name", F.struct("type", "mention_count").alias("o")), new.select("name", F.struct("type", "mention_count").alias("n"))
    return o.join(n, "name", "full").select("name", F.coalesce("o.type", "n.type").alias("type"), (F.coalesce("o.mention_count", F.lit(0)) + F.coalesce("n.mention_count", F.lit(0))).alias("mention_count"))


def built(triples: DataFrame, saved: tuple[DataFrame, DataFrame] | None = None, snapshots: DataFrame | None = None, last: Column | None = None, reference: Column | None = None, half: float = 90.0, drift: float = 0.7) -> Built:
    """A graph from the triples of all zones, onto a `saved` one (entities, edges) if there is one.

    Edges are completed, and with `last`, when each was last reinforced, and `reference` decayed; inferred edges are
    marked and don't decay. Neighbours are compared with and added to the `snapshots` (name, neighbours, version).
    """
    entities, edges = graph.fold_entities(triples).select("name", "type", "mention_count"), graph.fold_edges(triples)
    edges = edges.select("src", "dst", "relation", "weight", "reinforcement_count")
    if saved is not None:
        kept = saved[1].filter(~F.coalesce("inferred", F.lit(False))) if "inferred" in saved[1].columns else saved[1]
        entities, edges = merged(saved[0], entities), reinforced(kept, edges)
    inferred = graph.complete(edges, ("depends_on", "part_of", *graph.TRANSITIVE))
    if last is not None and reference is not None:
        edges = graph.decay(edges.withColumn("last_reinforced", last), reference, half).drop("last_reinforced")
    every = edges.withColumn("inferred", F.lit(False)).unionByName(inferred.withColumn("reinforcement_count", F.lit(0).cast("long")).withColumn("inferred", F.lit(True)))
    near = graph.neighbour_sets(every)
    before = snapshots if snapshots is not None else near.limit(0).withColumn("version", F.lit(1))
    return Built(entities, every, graph.snapshot(before, near), graph.drift(before, near, drift))
