"""Points where a user plugs in: named metrics, datasets and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Metric = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]


def compute(metrics: dict[str, Metric], gold_nodes: DataFrame, gold_edges: DataFrame, pred_nodes: DataFrame, pred_edges: DataFrame) -> DataFrame:
    """(map_id, <name>_<column>...): every metric is called with the four frames and returns a row a map; maps that any metric knows are kept."""
    out = None
    for name, metric in metrics.items():
        found = metric(gold_nodes, gold_edges, pred_nodes, pred_edges)
        found = found.select("map_id", *(found[c].alias(f"{name}_{c}") for c in found.columns if c != "map_id"))
        out = found if out is None else out.join(found, "map_id", "full")
    if out is None:
        raise ValueError("no metric is given")
    return out


@dataclass
class DatasetAdapter:
    """Documents with their gold maps, by split: ``papers`` (id, text, split), ``nodes`` and ``edges`` (map_id, ...)."""

    papers: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def split(self, name: str | None = None) -> DatasetAdapter:
        papers = self.papers if name is None else self.papers.where(self.papers["split"] == name)
        ids = papers.select(papers["id"].alias("map_id")).distinct()
        return DatasetAdapter(papers, self.nodes.join(ids, "map_id", "left_semi"), self.edges.join(ids, "map_id", "left_semi"))

    def iterate(self) -> Iterator[dict]:
        """The papers one after the other, a partition at a time on the driver."""
        return (r.asDict(True) for r in self.papers.toLocalIterator())


@dataclass
class Models:
    """Factories of models by kind and name; a check, if given, says what is wrong with a model's settings."""

    factories: dict[tuple[str, str], Callable] = field(default_factory=dict)
    checks: dict[tuple[str, str], Callable[[dict], list[str]]] = field(default_factory=dict)

    def register(self, kind: str, name: str, factory: Callable, check: Callable[[dict], list[str]] | None = None) -> None:
        self.factories[kind, name] = factory
        if check:
            self.checks[kind, name] = check

    def wrong(self, kind: str, name: str, **settings) -> list[str]:
        """What is wrong, empty if nothing is: an unknown name, or what the check finds."""
        if (kind, name) not in self.factories:
            known = sorted(n for k, n in self.factories if k == kind)
            return [f"no {kind} model {name!r}; there are {known}"]
        return self.checks.get((kind, name), lambda _: [])(settings)

    def get(self, kind: str, name: str, **settings) -> Callable:
        """A factory without arguments, for ``inference.mapped`` and the like."""
        if found := self.wrong(kind, name, **settings):
            raise ValueError("; ".join(found))
        factory = self.factories[kind, name]
        return (lambda: factory(**settings)) if settings else factory
