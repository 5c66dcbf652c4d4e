"""The logical plan of a topology: a chain of nodes from a sink back to its sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Node:
    parent: Node | None = None

    @property
    def kind(self) -> str:
        return type(self).__name__.lower()

    def parents(self) -> tuple[Node, ...]:
        return (self.parent,) if self.parent else ()

    def walk(self) -> Iterator[Node]:
        """Parents first."""
        for p in self.parents():
            yield from p.walk()
        yield self


@dataclass(frozen=True)
class Source(Node):
    rows: DataFrame | None = None
    name: str = "source"
    one_partition: bool = False


@dataclass(frozen=True)
class Project(Node):
    columns: dict[str, Column] = field(default_factory=dict)
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter(Node):
    predicate: Column | None = None
    keep: bool = True


@dataclass(frozen=True)
class FlatMap(Node):
    values: Column | None = None
    name: str = "value"


@dataclass(frozen=True)
class MapAsync(Node):
    call: Callable[[Any], Any] | None = None
    column: str = ""
    name: str = ""
    type: str = "string"
    concurrency: int = 8


@dataclass(frozen=True)
class EventTime(Node):
    micros: Column | None = None


@dataclass(frozen=True)
class KeyBy(Node):
    key: Column | None = None


@dataclass(frozen=True)
class Shuffle(Node):
    partitions: int | None = None


@dataclass(frozen=True)
class Dedupe(Node):
    key: Column | None = None
    most: int | None = None
    name: str | None = None
    within_us: int | None = None


@dataclass(frozen=True)
class Process(Node):
    init: Callable[[], Any] | None = None
    step: Callable[[Any, dict], tuple[Any, dict | None]] | None = None
    schema: str = ""
    name: str | None = None
    ttl_us: int | None = None


@dataclass(frozen=True)
class Windowed(Node):
    shape: str = "tumbling"  # or sliding, session
    size_us: int = 0
    slide_us: int = 0
    lateness_us: int = 0
    name: str | None = None


@dataclass(frozen=True)
class Aggregate(Node):
    columns: tuple[Column, ...] = ()


@dataclass(frozen=True)
class Fold(Node):
    """A user's aggregate of windows; schema is that of the rows emit() gives, without keys and bounds."""

    init: Callable[[], Any] | None = None
    add: Callable[[Any, dict], Any] | None = None
    emit: Callable[[dict, Any], dict] | None = None
    merge: Callable[[Any, Any], Any] | None = None
    schema: str = ""


@dataclass(frozen=True)
class IntervalJoin(Node):
    other: Node | None = None
    window_us: int = 0
    bound: str = "strict"
    name: str | None = None

    def parents(self) -> tuple[Node, ...]:
        return tuple(p for p in (self.parent, self.other) if p)


@dataclass(frozen=True)
class Sink(Node):
    write: Callable[[DataFrame, int], None] | None = None
    idempotent: bool = False


STATEFUL = (Dedupe, Process, Windowed, IntervalJoin)


def check_names(node: Node) -> None:
    """Names of stateful steps must differ within their kind."""
    seen: set[tuple[str, str]] = set()
    for n in dict.fromkeys(id(x) for x in node.walk()):
        x = next(y for y in node.walk() if id(y) == n)
        if isinstance(x, STATEFUL) and x.name:
            if (x.kind, x.name) in seen:
                raise ValueError(f"two {x.kind} steps are named {x.name!r}")
            seen.add((x.kind, x.name))


def stages(node: Node) -> list[list[str]]:
    """Kinds of the nodes of each stage, cut at shuffles: n shuffles make n + 1 stages."""
    out: list[list[str]] = [[]]
    for n in node.walk():
        if isinstance(n, Shuffle):
            out.append([])
        else:
            out[-1].append(n.kind)
    return out


def lint(node: Node) -> list[str]:
    """Stateful steps that no shuffle precedes: Spark exchanges rows there by itself, other runners would not."""
    out = []
    for n in node.walk():
        if isinstance(n, STATEFUL):
            for side, p in zip(("", " (right side)"), n.parents(), strict=False):
                if not any(isinstance(x, Shuffle) for x in p.walk()):
                    out.append(f"{n.kind}{side} has no shuffle before it")
    return out


def fingerprint(node: Node) -> str:
    """Kinds in order, with names, sizes, lateness, bounds and schemas: a checkpoint belongs to one fingerprint. Expressions and functions aren't in it, as
    they have no text that stays the same between runs."""

    def of(n: Node) -> str:
        plain = {f.name: v for f in fields(n) if isinstance(v := getattr(n, f.name), (str, int, tuple)) and all(isinstance(x, str) for x in (v if isinstance(v, tuple) else ()))}
        if isinstance(n, Source) and n.rows is not None:
            plain["columns"] = n.rows.schema.simpleString()
        if isinstance(n, (Project, Aggregate)):
            plain["columns"] = list(n.columns) if isinstance(n.columns, dict) else len(n.columns)
        return f"{n.kind}({', '.join(f'{k}={v!r}' for k, v in plain.items())})"

    return ">".join(map(of, node.walk()))
