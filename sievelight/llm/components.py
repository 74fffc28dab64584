"""Connected components of an edge table, by rounds of contraction.

In a round every vertex is given to the least vertex of its closed neighbourhood, and each edge then joins the
two new owners; edges within an owner vanish.  Stars vanish in one round.  The first rounds take the vertices' own order,
so that a hub that is the least of its neighbours takes them all; later ones take a seeded order of hashes, in which
each round is expected to remove a constant share of the vertices of any graph, chains too.  The owners of the rounds are composed
from the last to the first.

A round is a grouped minimum (combined before the shuffle) and two equi-joins whose large side AQE can split, so a vertex
with a third of all edges does not bind one task.  Edges and owners are written tables; a round's edges are deleted when
the next one's are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rounds in the vertices' own order before seeded orders.
OWN_ORDER = 2


def connected_components(edges: DataFrame, tables: Scratch, max_rounds: int = 200) -> DataFrame:
    """(u, v) of any comparable type -> (vertex, component), component being one vertex of it.

    Vertices without an edge do not appear; loops, repeated edges and nulls are ignored.  An empty
    edge table gives an empty result.  Raises if edges are left after max_rounds."""
    edges = tables.keep(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    owners = []
    for r in range(max_rounds):
        if owners and edges.isEmpty():
            break
        rank = (lambda x: F.struct(x)) if r < OWN_ORDER else (lambda x: F.struct(F.xxhash64(x, F.lit(r)), x))  # noqa: B023
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        near = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        least = F.when(rank(F.col("u")) < F.col("m"), F.col("u")).otherwise(F.col("m.v"))
        owner = tables.keep(near.select(F.col("u").alias("vertex"), least.alias("owner")))
        owners.append(owner)
        of = lambda name: owner.select(F.col("vertex").alias(name), F.col("owner").alias(f"{name}_owner"))  # noqa: B023, E731
        moved = edges.join(of("u"), "u").join(of("v"), "v").where("u_owner != v_owner")
        done, edges = edges, tables.keep(moved.select(F.greatest("u_owner", "v_owner").alias("u"), F.least("u_owner", "v_owner").alias("v")).distinct())
        tables.drop(done)
    else:
        raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
    out = owners[-1].select("vertex", F.col("owner").alias("component"))
    for owner in reversed(owners[:-1]):
        later = out.select(F.col("vertex").alias("owner"), "component")
        out = owner.join(later, "owner", "left").select("vertex", F.coalesce("component", "owner").alias("component"))
    out = tables.keep(out) if len(owners) > 1 else out
    tables.release(edges, *(owners if len(owners) > 1 else []))
    return out
