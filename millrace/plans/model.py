"""The model: concepts, datasources and the relations between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..lang.parser import LanguageError, Node

#: The type of a key that numbers the rows of one datasource and is bound by no column: rows are a bag.
ROW = "rowid"


@dataclass
class Concept:
    address: str
    purpose: str
    type: str | None = None
    keys: frozenset[str] | None = None
    lineage: Node | None = None
    #: The values its type allows; empty: any.
    domain: tuple = ()

    @property
    def is_row(self) -> bool:
        return self.type == ROW


@dataclass
class Datasource:
    """columns: for each concept the column expression and the marks ~ (partial) and ? (nullable)."""

    name: str
    columns: dict[str, tuple]
    grain: frozenset[str]
    load: Callable[[], DataFrame]
    partial: bool = False
    where: Node | None = None
    complete: Node | None = None
    aggregates: dict[str, Node] = field(default_factory=dict)
    published: bool = True
    write_to: str | None = None
    incremental: str | None = None
    partition: list[str] = field(default_factory=list)
    rowset: bool = False
    #: Data from outside, never rebuilt by a refresh.
    root: bool = False
    freshness: str | None = None
    within: str = "0 second"
    refresh: str | None = None
    #: For rowsets: keys of the model that it was made with, by its column; they join it where they are asked for beside it.
    echo: dict[str, str] = field(default_factory=dict)
    #: For programs: the table, narrowed to columns and by (column, operator, value) conditions that rows are tested for again.
    push: Callable[[list, list], DataFrame] | None = None

    def is_partial(self, concept: str) -> bool:
        return self.partial or "~" in self.columns.get(concept, (None, ""))[1]


class Model:
    def __init__(self):
        self.concepts: dict[str, Concept] = {}
        self.datasources: dict[str, Datasource] = {}
        self.macros: dict[str, tuple] = {}
        self.types: dict[str, str] = {}
        #: Concepts that stand for another one, and the relation it was declared with.
        self.same: dict[str, str] = {}
        #: Closures found while a select is planned, during which the model stands still; else None.
        self.memo: dict | None = None

    def add(self, concept: Concept) -> None:
        self.concepts[concept.address] = concept

    def address(self, name: str) -> str:
        for n in (name, name.removeprefix("local.")):
            if n in self.concepts:
                return self.canonical(n)
        raise LanguageError(f"unknown concept {name}")

    def canonical(self, address: str) -> str:
        seen = set()
        while address in self.same and address not in seen:
            seen.add(address)
            address = self.same[address]
        return address

    def natural_keys(self, address: str) -> frozenset[str]:
        """The grain of a root concept: itself for keys, its keys for properties."""
        c = self.concepts[address]
        if c.purpose in ("property", "unique") and c.keys is not None:
            return frozenset(self.canonical(k) for k in c.keys)
        return frozenset([self.canonical(address)])

    def minimal(self, keys: frozenset[str]) -> frozenset[str]:
        """keys without those that the others determine through some datasource."""
        out = set(keys)
        for k in sorted(keys):
            rest = out - {k}
            if rest and k in self.closure(frozenset(rest)):
                out = rest
        return frozenset(out)

    def closure(self, keys: frozenset[str]) -> frozenset[str]:
        """All concepts that have one value for each value of keys."""
        if self.memo is not None and keys in self.memo:
            return self.memo[keys]
        known, grown = set(keys), True
        while grown:
            grown = False
            for d in self.datasources.values():
                if d.grain and d.grain <= known and not set(d.columns) <= known:
                    known |= set(d.columns)
                    grown = True
            for c in self.concepts.values():
                if c.keys and c.address not in known and c.purpose in ("property", "unique") and {self.canonical(k) for k in c.keys} <= known:
                    known.add(c.address)
                    grown = True
        out = frozenset(known)
        if self.memo is not None:
            self.memo[keys] = out
        return out
