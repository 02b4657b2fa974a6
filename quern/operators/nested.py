"""Nested create and update: an input with creates, connects and more below its relationship fields, planned as deltas of tables.

`plan_create` takes rows whose relationship columns are structs of lists, `create` (node, edge) and `connect` (where, edge), to any depth;
`rows_of` makes such rows of dictionaries. `plan_update` takes a predicate and one nested dictionary of changes:

    {"name": "x", "chapters": {"create": [{"node": {...}, "edge": {...}}], "connect": [{"where": {...}, "edge": {...}}], "disconnect": [{"where": {...}}],
                               "update": {"where": {...}, "node": {... nested again ...}, "edge": {...}}, "delete": [{"where": {...}}]}}

Both return steps (Delta): nodes and edges to create, to set or to delete, each a table. `applied` folds them into new tables, `counts` adds up what
they do. All steps of one plan read the graph as it was before, so their order doesn't matter: disconnecting everything and connecting one node
replaces what was there. Deleting wins: what hangs on a deleted node goes, new edges included.

Defined cases. A created node without an id gets the SHA-256 of its fields. Equal created nodes are one. `connect` on create takes a node that isn't
there as a stub with only its id (on_missing="stub"), or drops the edge ("drop"); a `where` of other fields than the id connects
to all nodes that equal it in those fields. `connect` in an update joins every matched node with every target, which is what it asks for; a pair
that is connected already isn't doubled but gets the edge's properties. `create` in an update makes each node once and connects every matched node
to it, and makes none where none matched. A predicate that is null for a node doesn't match. Ids within one edge type must tell labels apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import Field, Model
from .predicates import filtered

PAIR = ["src_id", "dst_id"]


@dataclass
class Delta:
    """action: create, set or delete; kind: node or edge; name: label or type. rows: whole rows to create; key and new values to
    set; keys to delete. The keys of an edge are its two ends."""

    action: str
    kind: str
    name: str
    rows: DataFrame


# --- inputs ---------------------------------------------------------------------------------------------------------------------------------


def _input_type(model: Model, label: str, rows: list[dict]) -> T.StructType:
    nodes, fields = model.nodes[label].schema, model.fields_of(label)
    out = []
    for name in dict.fromkeys(k for r in rows for k in r):
        if name in fields:
            out.append(T.StructField(name, _relation_type(model, fields[name], [r[name] for r in rows if r.get(name)])))
        elif name in nodes.names:
            out.append(T.StructField(name, nodes[name].dataType))
        else:
            raise ValueError(f"{label} has no field {name}")
    return T.StructType(out)


def _relation_type(model: Model, f: Field, values: list[dict]) -> T.StructType:
    edges, target = model.edges[f.type].schema, model.nodes[f.target].schema
    properties = T.StructType([T.StructField(p, edges[p].dataType) for p in f.properties])
    out = []
    for kind, what in (("create", "node"), ("connect", "where")):
        entries = [e for v in values for e in v.get(kind, [])]
        if entries:
            inner = [e[what] for e in entries]
            shape = _input_type(model, f.target, inner) if kind == "create" else T.StructType([target[k] for k in dict.fromkeys(k for e in inner for k in e)])
            out.append(T.StructField(kind, T.ArrayType(T.StructType([T.StructField(what, shape), T.StructField("edge", properties)]))))
    return T.StructType(out)


def rows_of(model: Model, label: str, inputs: list[dict]) -> DataFrame:
    """Stated inputs as a table for plan_create."""
    kind = _input_type(model, label, inputs)

    def shaped(value: Any, t: T.DataType) -> Any:
        if isinstance(t, T.StructType) and isinstance(value, dict):
            return tuple(shaped(value.get(f.name), f.dataType) for f in t)
        if isinstance(t, T.ArrayType) and isinstance(value, list):
            return [shaped(v, t.elementType) for v in value]
        return value

    return _session(model).createDataFrame([shaped(r, kind) for r in inputs], kind)


def _session(model: Model) -> SparkSession:
    return next(iter(model.nodes.values())).sparkSession


# --- planning -------------------------------------------------------------------------------------------------------------------------------


def plan_create(model: Model, label: str, inputs: DataFrame, on_missing: str = "stub") -> list[Delta]:
    """Steps that create the rows of inputs and what is nested in them."""
    if on_missing not in ("stub", "drop"):
        raise ValueError(f"on_missing: {on_missing}")
    steps: list[Delta] = []
    wanted: list[tuple[Field, DataFrame]] = []
    _create(model, label, _with_id(model, label, inputs), steps, wanted)
    for f, edges in wanted:
        known = [model.nodes[f.target].select(F.col(model.key).alias("quern_id"))]
        known += [s.rows.select(F.col(model.key).alias("quern_id")) for s in steps if s.kind == "node" and s.name == f.target]
        every, at = reduce(DataFrame.unionByName, known), F.col(f.far) == F.col("quern_id")
        if on_missing == "drop":
            edges = edges.join(every, at, "left_semi")
        else:
            stubs = edges.join(every, at, "left_anti").select(F.col(f.far).alias(model.key)).where(F.col(model.key).isNotNull()).distinct()
            steps.append(Delta("create", "node", f.target, _like(stubs, model.nodes[f.target])))
        steps.append(Delta("create", "edge", f.type, edges.where("src_id is not null and dst_id is not null")))
    return steps


def _like(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of table; those that they lack are null."""
    return rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes))


def _with_id(model: Model, label: str, rows: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """rows with an id each; beside: columns that don't belong to the node."""
    fields, kind = model.fields_of(label), dict(model.nodes[label].dtypes)[model.key]
    own = [c for c in rows.columns if c not in fields and c not in (model.key, *beside)]
    if kind == "string":
        made = F.sha2(F.to_json(F.struct(F.lit(label).alias("quern_label"), *own)).cast("binary"), 256)
    else:
        made = F.raise_error(F.lit("a created node needs an id")).cast(kind)
    return rows.withColumn(model.key, F.coalesce(F.col(model.key), made) if model.key in rows.columns else made)


def _pairs(f: Field, edges: DataFrame, near: str, far: Column, properties: Column | None, table: DataFrame) -> DataFrame:
    ends = {f.near: F.col(near), f.far: far}
    kinds = dict(table.dtypes)
    given = [(properties[p] if properties is not None else F.lit(None)).cast(kinds[p]).alias(p) for p in f.properties]
    return edges.select(*(ends[e].cast(kinds[e]).alias(e) for e in PAIR), *given)


def _create(model: Model, label: str, rows: DataFrame, steps: list[Delta], wanted: list[tuple[Field, DataFrame]]) -> None:
    """rows have ids. Appends the nodes and their edges to what is created below; edges to given ids wait in wanted."""
    fields = model.fields_of(label)
    unknown = [c for c in rows.columns if c not in fields and c not in model.nodes[label].columns]
    if unknown:
        raise ValueError(f"{label} has no field {unknown[0]}")
    steps.append(Delta("create", "node", label, _like(rows.drop(*fields), model.nodes[label]).distinct()))
    for name, f in fields.items():
        if name not in rows.columns:
            continue
        shape = rows.schema[name].dataType.names
        table = model.edges[f.type]
        for kind, what in (("create", "node"), ("connect", "where")):
            if kind not in shape:
                continue
            each = rows.select(F.col(model.key).alias("quern_near"), F.explode(F.col(f"{name}.{kind}")).alias("quern_one"))
            parts = each.schema["quern_one"].dataType
            edge = F.col("quern_one.edge") if "edge" in parts.names and parts["edge"].dataType.names else None
            properties = None if edge is None else F.struct(*((edge[p] if p in parts["edge"].dataType.names else F.lit(None)).alias(p) for p in f.properties))
            each = each.withColumn("quern_edge", properties if properties is not None else F.lit(None))
            given = F.col("quern_edge") if properties is not None else None
            if kind == "create":
                inner = _with_id(model, f.target, each.select("quern_near", "quern_edge", "quern_one.node.*"), ("quern_near", "quern_edge"))
                steps.append(Delta("create", "edge", f.type, _pairs(f, inner, "quern_near", F.col(model.key), given, table).distinct()))
                _create(model, f.target, inner.drop("quern_near", "quern_edge"), steps, wanted)
            else:
                names = parts["where"].dataType.names
                if names == [model.key]:
                    wanted.append((f, _pairs(f, each, "quern_near", F.col(f"quern_one.where.{model.key}"), given, table).distinct()))
                else:
                    nodes = model.nodes[f.target].select(*(F.col(c).alias(f"quern_{i}") for i, c in enumerate(names)), F.col(model.key).alias("quern_far"))
                    met = each.join(nodes, reduce(lambda a, b: a & b, [F.col(f"quern_one.where.{c}") == F.col(f"quern_{i}") for i, c in enumerate(names)]))
                    steps.append(Delta("create", "edge", f.type, _pairs(f, met, "quern_near", F.col("quern_far"), given, table).distinct()))


def plan_update(model: Model, label: str, where: dict | None, update: dict[str, Any]) -> list[Delta]:
    """Steps that change the nodes of the predicate, their edges and what is connected to them."""
    steps: list[Delta] = []
    _update(model, label, filtered(model.label(label), where).select(model.key), update, steps)
    return steps


def _value(v: Any, kind: str) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast(kind)


def _update(model: Model, label: str, matched: DataFrame, update: dict[str, Any], steps: list[Delta]) -> None:
    nodes, key, fields = model.nodes[label], model.key, model.fields_of(label)
    kinds = dict(nodes.dtypes)
    own = {k: v for k, v in update.items() if k not in fields}
    unknown = [k for k in own if k not in kinds or k == key]
    if unknown:
        raise ValueError(f"{label} has no field {unknown[0]} to set")
    ids = matched.select(F.col(key).alias("quern_id"))
    if own:
        hit = nodes.join(ids, F.col(key) == F.col("quern_id"), "left_semi")
        steps.append(Delta("set", "node", label, hit.select(key, *(_value(v, kinds[k]).alias(k) for k, v in own.items()))))
    for name, f in fields.items():
        changes = update.get(name) or {}
        odd = [k for k in changes if k not in ("create", "connect", "disconnect", "update", "delete")]
        if odd:
            raise ValueError(f"{label}.{name}: {odd[0]}")
        if not changes:
            continue
        edges, properties = model.edges[f.type], dict(model.edges[f.type].dtypes)
        target, reach = model.label(f.target), lambda w, t=f.target: filtered(model.label(t), w).select(F.col(key).alias("quern_far"))
        linked = edges.join(ids, F.col(f.near) == F.col("quern_id"), "left_semi").join(target.nodes.select(F.col(key).alias("quern_end")), F.col(f.far) == F.col("quern_end"), "left_semi")

        def there(where: dict | None, linked=linked, f=f, reach=reach) -> DataFrame:
            return linked.join(reach(where), F.col(f.far) == F.col("quern_far"), "left_semi")

        for one in changes.get("create", []):
            rows = _with_id(model, f.target, rows_of(model, f.target, [one["node"]]))
            rows = rows.crossJoin(matched.limit(1).select(F.lit(True).alias("quern_any"))).drop("quern_any")  # one row, or none where none matched
            below: list[tuple[Field, DataFrame]] = []
            made: list[Delta] = []
            _create(model, f.target, rows, made, below)
            steps += made + [Delta("create", "edge", g.type, e.join(model.nodes[g.target].select(F.col(key).alias("quern_id")), F.col(g.far) == F.col("quern_id"), "left_semi")) for g, e in below]
            product = ids.crossJoin(rows.select(F.col(key).alias("quern_far")))
            steps.append(Delta("create", "edge", f.type, _stated(f, product, one.get("edge"), properties)))
        for one in changes.get("connect", []):
            pairs = _stated(f, ids.crossJoin(reach(one.get("where"))), one.get("edge"), properties)
            held = edges.select(F.col("src_id").alias("quern_s"), F.col("dst_id").alias("quern_t"))
            at = (F.col("src_id") == F.col("quern_s")) & (F.col("dst_id") == F.col("quern_t"))
            steps.append(Delta("create", "edge", f.type, pairs.join(held, at, "left_anti")))
            if one.get("edge"):
                steps.append(Delta("set", "edge", f.type, pairs.join(held, at, "left_semi").select(*PAIR, *one["edge"])))
        for one in changes.get("disconnect", []):
            steps.append(Delta("delete", "edge", f.type, there(one.get("where")).select(*PAIR).distinct()))
        if changes.get("update"):
            one = changes["update"]
            hit = there(one.get("where"))
            if one.get("edge"):
                steps.append(Delta("set", "edge", f.type, hit.select(*PAIR, *(_value(v, properties[k]).alias(k) for k, v in one["edge"].items())).dropDuplicates(PAIR)))
            if one.get("node"):
                _update(model, f.target, hit.select(F.col(f.far).alias(key)).distinct(), one["node"], steps)
        for one in changes.get("delete", []):
            steps.append(Delta("delete", "node", f.target, there(one.get("where")).select(F.col(f.far).alias(key)).distinct()))


def _stated(f: Field, product: DataFrame, edge: dict | None, kinds: dict[str, str]) -> DataFrame:
    """Edges of quern_id and quern_far with stated properties."""
    ends = {f.near: F.col("quern_id"), f.far: F.col("quern_far")}
    return product.select(*(ends[e].cast(kinds[e]).alias(e) for e in PAIR), *(_value((edge or {}).get(p), kinds[p]).alias(p) for p in f.properties))


# --- folding --------------------------------------------------------------------------------------------------------------------------------


def _of(steps: list[Delta], action: str, kind: str, name: str) -> list[DataFrame]:
    return [s.rows for s in steps if (s.action, s.kind, s.name) == (action, kind, name)]


def _without(rows: DataFrame, gone: list[DataFrame], keys: list[str], at: list[str]) -> DataFrame:
    for g in gone:
        g = g.select(*(F.col(k).alias(f"quern_gone_{i}") for i, k in enumerate(keys)))
        rows = rows.join(g, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"quern_gone_{i}") for i, c in enumerate(at)]), "left_anti")
    return rows


def _set(rows: DataFrame, changes: list[DataFrame], keys: list[str]) -> DataFrame:
    columns = rows.columns
    for change in changes:
        new = [c for c in change.columns if c not in keys]
        change = change.select(*(F.col(k).alias(f"quern_key_{i}") for i, k in enumerate(keys)), F.struct(*new).alias("quern_new"))
        rows = rows.join(change, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"quern_key_{i}") for i, k in enumerate(keys)]), "left")
        hit = F.col("quern_key_0").isNotNull()
        rows = rows.select(*(F.when(hit, F.col(f"quern_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns))
    return rows


def applied(model: Model, steps: list[Delta]) -> Model:
    """The tables after the steps; tables that no step touches are the same objects."""
    key, touched = model.key, {(s.kind, s.name) for s in steps}
    gone = {label: found for label in model.nodes if (found := _of(steps, "delete", "node", label))}
    nodes, edges = dict(model.nodes), dict(model.edges)
    for label, table in model.nodes.items():
        if ("node", label) in touched:
            rows = _set(table, _of(steps, "set", "node", label), [key])
            for made in _of(steps, "create", "node", label):
                rows = rows.unionByName(made)
            nodes[label] = _without(rows, gone.get(label, []), [key], [key])
    for kind, table in model.edges.items():
        sources, targets = model.ends(kind)
        if ("edge", kind) not in touched and not gone.keys() & (sources | targets):
            continue
        rows = _set(_without(table, _of(steps, "delete", "edge", kind), PAIR, PAIR), _of(steps, "set", "edge", kind), PAIR)
        for made in _of(steps, "create", "edge", kind):
            rows = rows.unionByName(made.select(*rows.columns))
        for end, labels in (("src_id", sources), ("dst_id", targets)):
            for label in sorted(labels & gone.keys()):
                rows = _without(rows, gone[label], [key], [end])
        edges[kind] = rows
    return Model(nodes, edges, model.fields, key)


COUNTS = ("nodes_created", "nodes_updated", "nodes_deleted", "relationships_created", "relationships_updated", "relationships_deleted")


def counts(model: Model, steps: list[Delta]) -> DataFrame:
    """One row: nodes and relationships created, updated and deleted, what goes with a deleted node included; a thing that several steps
    update or delete counts once."""
    key, parts = model.key, []

    def add(name: str, rows: list[DataFrame], columns: list[str], once: bool) -> None:
        if rows:
            every = reduce(DataFrame.unionByName, [r.select(*columns) for r in rows])
            parts.append((every.distinct() if once else every).select(F.lit(name).alias("name")))

    gone = {label: found for label in model.nodes if (found := _of(steps, "delete", "node", label))}
    for label in model.nodes:
        add("nodes_created", _of(steps, "create", "node", label), [key], False)
        add("nodes_updated", _of(steps, "set", "node", label), [key], True)
        add("nodes_deleted", _of(steps, "delete", "node", label), [key], True)
    for kind, table in model.edges.items():
        sources, targets = model.ends(kind)
        lost = list(_of(steps, "delete", "edge", kind))
        for end, labels in (("src_id", sources), ("dst_id", targets)):
            for label in sorted(labels & gone.keys()):
                lost += [table.join(g.select(F.col(key).alias("quern_gone")), F.col(end) == F.col("quern_gone"), "left_semi").select(*PAIR) for g in gone[label]]
        add("relationships_created", _of(steps, "create", "edge", kind), PAIR, False)
        add("relationships_updated", _of(steps, "set", "edge", kind), PAIR, True)
        if lost:
            at = (F.col("src_id") == F.col("quern_s")) & (F.col("dst_id") == F.col("quern_t"))
            pairs = reduce(DataFrame.unionByName, lost).distinct().select(F.col("src_id").alias("quern_s"), F.col("dst_id").alias("quern_t"))
            add("relationships_deleted", [table.join(pairs, at, "left_semi")], PAIR, False)  # parallel edges count each
    if not parts:
        return _session(model).createDataFrame([(0,) * len(COUNTS)], ", ".join(f"{c} long" for c in COUNTS))
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(*(F.count(F.when(F.col("name") == c, 1)).alias(c) for c in COUNTS))
