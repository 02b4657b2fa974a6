"""Create, update, delete, merge and connect as functions from tables to new tables.

Plain Parquet has no row-level writes, so a mutation returns the new table (to be written where the caller wants it)
and the counts that the mutation reports are aggregates over what changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes and the new rows; columns that a row doesn't have are null."""
    return nodes.unionByName(rows, allowMissingColumns=True).select(*nodes.columns)


def update(nodes: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """The listed fields of matching rows set; a condition that is null doesn't match."""
    hit = F.coalesce(where, F.lit(False))
    return nodes.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in nodes.columns))


def update_from(nodes: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Fields set from a table of changes by key (one row a key); keys that don't exist are ignored."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("quern_key"), F.struct(*fields).alias("quern_new"))
    joined = nodes.join(new, F.col(key) == F.col("quern_key"), "left")
    return joined.select(*(F.when(F.col("quern_key").isNotNull(), F.col(f"quern_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in nodes.columns))


def delete(nodes: DataFrame, doomed: DataFrame, edges: dict[str, tuple[DataFrame, bool, bool]], key: str = "id") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Nodes without those in `doomed` (key column), edge tables without edges at them, and one row of counts.

    edges: name to (table, its source is this label, its target is this label).
    """
    gone = nodes.join(doomed.select(F.col(key).alias("quern_key")).distinct(), F.col(key) == F.col("quern_key"), "left_semi").select(F.col(key).alias("quern_gone"))
    gone = gone.hint("shuffle_hash")  # its side alone is held by a task, and the edges, which are more, are neither sorted nor held
    left = nodes.join(gone, F.col(key) == F.col("quern_gone"), "left_anti")
    kept, lost = {}, []
    for name, (table, at_source, at_target) in edges.items():
        rest = table
        for column, here in (("src_id", at_source), ("dst_id", at_target)):
            if here:
                lost.append(rest.join(gone, F.col(column) == F.col("quern_gone"), "left_semi").select(F.lit(name).alias("edge")))
                rest = rest.join(gone, F.col(column) == F.col("quern_gone"), "left_anti")
        kept[name] = rest
    counts = gone.select(F.lit(1).alias("node"), F.lit(0).alias("edge"))
    counts = reduce(DataFrame.unionByName, [counts, *(x.select(F.lit(0).alias("node"), F.lit(1).alias("edge")) for x in lost)])
    counts = counts.agg(F.coalesce(F.sum("node"), F.lit(0)).alias("nodes_deleted"), F.coalesce(F.sum("edge"), F.lit(0)).alias("relationships_deleted"))
    return left, kept, counts


def merge(nodes: DataFrame, inputs: DataFrame, match: list[str], on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> DataFrame:
    """Upsert: inputs that match a row on the given fields set `on_match` on it; the others become rows of their match
    fields and `on_create`. Expressions name the input's columns as in.<column>."""
    on_create, on_match = on_create or {}, on_match or {}
    n = nodes.withColumn("quern_old", F.lit(True)).alias("node")
    i = inputs.withColumn("quern_in", F.lit(True)).alias("in")
    joined = n.join(i, reduce(lambda a, b: a & b, [F.col(f"node.{c}").eqNullSafe(F.col(f"in.{c}")) for c in match]), "full_outer")
    old, new = F.col("quern_old").isNotNull(), F.col("quern_in").isNotNull()
    out = []
    for c in nodes.columns:
        fresh = on_create.get(c, F.col(f"in.{c}") if c in match else F.lit(None))
        changed = on_match.get(c, F.col(f"node.{c}"))
        out.append(F.when(old & new, changed).when(old, F.col(f"node.{c}")).otherwise(fresh).cast(nodes.schema[c].dataType).alias(c))
    return joined.select(*out)


def connect(edges: DataFrame, sources: DataFrame, targets: DataFrame, properties: dict[str, Column] | None = None, key: str = "id") -> DataFrame:
    """edges and one from every source to every target: the product that was asked for, from two stated sets."""
    given = properties or {}
    from_ids, to_ids = sources.select(F.col(key).alias("src_id")), targets.select(F.col(key).alias("dst_id"))
    made = from_ids.crossJoin(to_ids).select("src_id", "dst_id", *(v.alias(k) for k, v in given.items()))
    return edges.unionByName(made, allowMissingColumns=True).select(*edges.columns)


def connect_rows(edges: DataFrame, rows: DataFrame, sources: DataFrame, targets: DataFrame, on_missing: str = "drop", key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batched edge creation: (edges, stubs of missing sources, stubs of missing targets).

    on_missing "drop": a row with a missing end is dropped; "stub": the edge stays, and the missing ends are returned as
    bare nodes with only their key.
    """
    if on_missing not in ("drop", "stub"):
        raise ValueError(f"on_missing: {on_missing}")
    s, t = sources.select(F.col(key).alias("quern_s")), targets.select(F.col(key).alias("quern_t"))
    at_s, at_t = F.col("src_id") == F.col("quern_s"), F.col("dst_id") == F.col("quern_t")
    no_s = rows.join(s, at_s, "left_anti").where("src_id is not null").select(F.col("src_id").alias(key)).distinct()
    no_t = rows.join(t, at_t, "left_anti").where("dst_id is not null").select(F.col("dst_id").alias(key)).distinct()
    if on_missing == "drop":
        good = rows.join(s, at_s, "left_semi").join(t, at_t, "left_semi")
        no_s, no_t = no_s.limit(0), no_t.limit(0)
    else:
        good = rows.where("src_id is not null and dst_id is not null")
    return edges.unionByName(good, allowMissingColumns=True).select(*edges.columns), no_s, no_t


def disconnect(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.select(F.col("src_id").alias("quern_s"), F.col("dst_id").alias("quern_t"))
    return edges.join(gone, (F.col("src_id") == F.col("quern_s")) & (F.col("dst_id") == F.col("quern_t")), "left_anti")


def edges_of_lists(rows: DataFrame, key: str, children: str) -> DataFrame:
    """One edge for each id in a list column: what a nested connect on create writes."""
    return rows.select(F.col(key).alias("src_id"), F.explode(children).alias("dst_id"))
