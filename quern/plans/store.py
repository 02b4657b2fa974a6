"""A versioned store of graph tables: readers see one snapshot, whole, whatever is being written.

    <root>/tables/<name>/<unique>/   the files of one state of one table, never changed
    <root>/versions/<number>.json    a manifest: for each table its folder, columns and layout

A write puts new tables into new folders and then publishes the next manifest, which appears at once (a rename that fails where the number is taken: two
writers at a time, and the later one gets Conflict). Until then readers see the manifest before; a write that dies leaves nothing that anybody
reads. Tables that a write doesn't name keep their folder, so writing vectors back costs one table, and a new state may be computed from the one it
replaces. `vacuum` deletes folders that the last versions don't name.

Layout: a table may be bucketed by the columns that its joins use (then Spark joins it without shuffling it), and carry Bloom filters for columns by
which single rows are looked up (files that can't hold the id aren't read). Bucketed tables are read through a table in the session's catalogue.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Model
from ..sources import schemas
from ..sources.shared import Files
from .load import Graph, search_edges

#: The table that expansion joins with its seeds.
SEARCH_EDGES, EXPANDED_BY = "search_edges", ("src_type", "src_id")


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Layout:
    """How a table is written: bucketed and sorted by columns, Bloom filters on columns."""

    buckets: int = 0
    by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    # --- reading ---

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json")]

    def current(self) -> int:
        """The newest version; 0 where none is there."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        number = self.current() if version is None else version
        return json.loads(self.files.read(f"{self.root}/versions/{number:08d}.json"))["tables"] if number else {}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if name not in held:
            raise KeyError(f"no table {name}")
        return self._read(held[name])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one snapshot."""
        return {n: self._read(entry) for n, entry in self.manifest(version).items()}

    def _read(self, entry: dict) -> DataFrame:
        at = f"{self.root}/{entry['folder']}"
        if not entry["buckets"]:
            return self.spark.read.schema(entry["schema"]).parquet(at)
        name = f"quern_{entry['folder'].rsplit('/', 1)[1]}"
        by = ", ".join(f"`{c}`" for c in entry["by"])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({entry['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {entry['buckets']} BUCKETS LOCATION '{at}'")
        return self.spark.table(f"`{name}`")

    # --- writing ---

    def write(self, changes: dict[str, DataFrame | Callable | None], layouts: dict[str, Layout] | None = None, whole: bool = False) -> int:
        """The next version: named tables are written anew (None: dropped), the others stay, or, if `whole`, go. A
        function makes a table of those that this version has so far. Returns the version's number."""
        before = self.current()
        tables = {} if whole else self.manifest(before)
        for name, rows in changes.items():
            if rows is None:
                tables.pop(name, None)
                continue
            if callable(rows):
                rows = rows({n: self._read(e) for n, e in tables.items() if not e["buckets"]})
            old = tables.get(name)
            kept = Layout(old["buckets"], tuple(old["by"]), tuple(old["bloom"])) if old else Layout()
            tables[name] = self._write(name, rows, (layouts or {}).get(name, kept))
        self.files.fs.mkdirs(self.files.path(f"{self.root}/versions"))
        if not self.files.publish(f"{self.root}/versions/{before + 1:08d}.json", json.dumps({"tables": tables}, indent=1)):
            raise Conflict(f"version {before + 1} is there already")
        return before + 1

    def _write(self, name: str, rows: DataFrame, layout: Layout) -> dict:
        unique = uuid.uuid4().hex
        folder = f"tables/{name}/{unique}"
        dealt = rows.repartition(layout.buckets, *layout.by) if layout.buckets else rows  # one file for each bucket
        out = dealt.write.format("parquet").options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in layout.bloom})
        if layout.buckets:
            out.bucketBy(layout.buckets, *layout.by).sortBy(*layout.by).option("path", f"{self.root}/{folder}").saveAsTable(f"quern_{unique}")
        else:
            out.save(f"{self.root}/{folder}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return {"folder": folder, "schema": schema, "buckets": layout.buckets, "by": list(layout.by), "bloom": list(layout.bloom)}

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the manifests before the last `keep` and every folder that none of these names; returns the folders. Folders of a write that
        is still going on go too: call it when none is."""
        last = self.versions()[-keep:]
        named = {e["folder"] for v in last for e in self.manifest(v).values()}
        gone = [f"tables/{t}/{u}" for t in self._names("tables") for u in self._folders(t) if f"tables/{t}/{u}" not in named]
        for folder in gone:
            self.files.delete(f"{self.root}/{folder}")
        for v in set(self.versions()) - set(last):
            self.files.delete(f"{self.root}/versions/{v:08d}.json")
        return gone

    def _names(self, folder: str) -> list[str]:
        """Table names, which may hold one slash."""
        out = []
        for n in self.files.names(f"{self.root}/{folder}"):
            inner = self.files.names(f"{self.root}/{folder}/{n}")
            out += [f"{n}/{i}" for i in inner] if n in ("nodes", "edges") else [n]
        return out

    def _folders(self, table: str) -> list[str]:
        return self.files.names(f"{self.root}/tables/{table}")


# --- graphs ---------------------------------------------------------------------------------------------------------------------------------


#: The counters that a load reports, and the table of each; "embedded" counters are of nodes that have a vector.
COUNTERS = {
    "Volumes": "nodes/Volume", "Books": "nodes/Book", "Chapters": "nodes/Chapter", "Verses": "nodes/Verse", "TGEntries": "nodes/TopicalGuideEntry", "BDEntries": "nodes/BibleDictEntry",
    "IDXEntries": "nodes/IndexEntry", "JSTPassages": "nodes/JSTPassage", "CrossRefs": "edges/CROSS_REF", "VerseTGRefs": "edges/TG_FOOTNOTE", "VerseBDRefs": "edges/BD_FOOTNOTE",
    "VerseJSTRefs": "edges/JST_FOOTNOTE", "TGVerseRefs": "edges/TG_VERSE_REF", "BDVerseRefs": "edges/BD_VERSE_REF", "IDXVerseRefs": "edges/IDX_VERSE_REF", "TGSeeAlso": "edges/TG_SEE_ALSO",
    "BDSeeAlso": "edges/BD_SEE_ALSO", "IDXSeeAlso": "edges/IDX_SEE_ALSO", "IDXTGRefs": "edges/IDX_TG_REF", "IDXBDRefs": "edges/IDX_BD_REF", "TGBDRefs": "edges/TG_BD_REF",
    "JSTCompares": "edges/COMPARES", "VerseGroups": "nodes/VerseGroup",
}
EMBEDDED = {
    "EmbVerseGroups": "nodes/VerseGroup", "EmbChapters": "nodes/Chapter", "EmbTGEntries": "nodes/TopicalGuideEntry", "EmbBDEntries": "nodes/BibleDictEntry", "EmbIDXEntries": "nodes/IndexEntry",
    "EmbJSTPassages": "nodes/JSTPassage",
}
PHASES = ("scriptures", "footnotes", "study helps", "references")


class Counters:
    """Metrics that are collected while tables are written: no job of their own."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, name: str, rows: DataFrame) -> DataFrame:
        self.seen[name] = Observation(name)
        label = name.removeprefix("nodes/")
        metrics = [F.count(F.lit(1)).alias("rows")]
        if label in schemas.VECTOR_FIELD:
            metrics.append(F.count_if(F.size(schemas.VECTOR_FIELD[label]) > 0).alias("embedded"))
        if name == "rejects":
            metrics += [F.count_if(F.col("phase") == p).alias(p) for p in PHASES]
        return rows.observe(self.seen[name], *metrics)

    def values(self) -> dict[str, int]:
        """All counters, and Warnings with the rejects of each phase; call it when the tables are written."""
        got = {n: o.get for n, o in self.seen.items()}
        out = {c: got[t]["rows"] for c, t in COUNTERS.items() if t in got} | {c: got[t]["embedded"] for c, t in EMBEDDED.items() if t in got}
        if "rejects" in got:
            out |= {"Warnings": got["rejects"]["rows"]} | {f"Warnings: {p}": got["rejects"][p] for p in PHASES}
        return out


def save_graph(store: GraphStore, graph: Graph, buckets: int = 64, rejects: bool = True, counters: Counters | None = None) -> int:
    """A full reload as one version: nodes, edges, the edges that search expands by (each once, bucketed by their source), and the rejects."""
    tables = {f"nodes/{k}": v for k, v in graph.nodes.items()} | {f"edges/{k}": v for k, v in graph.edges.items()}
    layouts = {name: Layout(bloom=("id",)) if name.startswith("nodes/") else Layout(bloom=("src_id", "dst_id")) for name in tables}
    if rejects and graph.rejects:
        tables["rejects"] = graph.all_rejects()
    if counters:
        tables = {name: counters.watch(name, rows) for name, rows in tables.items()}
    edges = lambda held: {k: held[f"edges/{k}"] for k in graph.edges}
    tables[SEARCH_EDGES] = lambda held: search_edges(Graph({}, edges(held))).distinct()  # of the edges just written, which aren't made again
    layouts[SEARCH_EDGES] = Layout(buckets, EXPANDED_BY)
    return store.write(tables, layouts, whole=True)


def open_graph(store: GraphStore, version: int | None = None) -> Graph:
    """The graph of one version, with all its tables from the same snapshot."""
    held = store.tables(store.current() if version is None else version)
    pick = lambda kind: {n.split("/", 1)[1]: t for n, t in held.items() if n.startswith(f"{kind}/")}
    return Graph(pick("nodes"), pick("edges"), [held["rejects"]] if "rejects" in held else [])


def save_model(store: GraphStore, before: Model, after: Model) -> int:
    """What a mutation changed, as one version; tables that it didn't touch keep their files."""
    changed = {f"nodes/{k}": v for k, v in after.nodes.items() if v is not before.nodes.get(k)}
    changed |= {f"edges/{k}": v for k, v in after.edges.items() if v is not before.edges.get(k)}
    if SEARCH_EDGES in store.manifest() and any(n.startswith("edges/") for n in changed):
        changed[SEARCH_EDGES] = search_edges(Graph(after.nodes, after.edges)).distinct()
    return store.write(changed)


def save_vectors(store: GraphStore, label: str, nodes: DataFrame) -> int:
    """A label's nodes with their vectors: only this table is written, and may be computed from the one it replaces."""
    if schemas.VECTOR_FIELD.get(label) not in nodes.columns:
        raise ValueError(f"{label} has no vectors")
    return store.write({f"nodes/{label}": nodes})
