"""A graph as tables: node tables by label, edge tables by type, and the fields by which labels reach each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import Label, Link


@dataclass(frozen=True)
class Field:
    """A relationship as a field of a label: edges of `type`, followed from src_id to dst_id or, where `inward`, back."""

    label: str
    name: str
    type: str
    target: str
    inward: bool = False
    properties: tuple[str, ...] = ()

    @property
    def near(self) -> str:
        return "dst_id" if self.inward else "src_id"

    @property
    def far(self) -> str:
        return "src_id" if self.inward else "dst_id"


@dataclass
class Model:
    """nodes: label to its table with a key column; edges: type to src_id, dst_id and properties. An edge table may serve
    several fields. Rows of an edge table that are equal in all columns are one edge; tables hold each once."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    fields: list[Field] = field(default_factory=list)
    key: str = "id"

    def fields_of(self, label: str) -> dict[str, Field]:
        return {f.name: f for f in self.fields if f.label == label and f.type in self.edges and f.target in self.nodes}

    def label(self, name: str) -> Label:
        """The label for predicates and selections, with all that can be reached from it."""
        made = {k: Label(v, self.key) for k, v in self.nodes.items()}
        for k, at in made.items():
            for f in self.fields_of(k).values():
                edges = self.edges[f.type]
                shown = edges.select(F.col(f.near).alias("near_id"), F.col(f.far).alias("far_id"), *f.properties)
                at.links[f.name] = Link(shown, "near_id", "far_id", made[f.target], f.properties)
        return made[name]

    def ends(self, kind: str) -> tuple[set[str], set[str]]:
        """Labels at the sources and at the targets of an edge type."""
        sources, targets = set(), set()
        for f in self.fields:
            if f.type == kind:
                sources.add(f.target if f.inward else f.label)
                targets.add(f.label if f.inward else f.target)
        return sources, targets
