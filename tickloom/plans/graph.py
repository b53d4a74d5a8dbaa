"""Named plans as a graph: each node makes a DataFrame from its dependencies'. Catalyst fuses and prunes within a plan; the graph adds names, outputs, timing and manifests."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fnv1a(data: bytes, value: int = 0xCBF29CE484222325) -> int:
    """FNV-1a of 64 bits."""
    for b in data:
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


@dataclass
class Node:
    name: str
    kind: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    output: bool = False


@dataclass
class PlanGraph:
    nodes: dict[str, Node] = field(default_factory=dict)

    def add(self, name: str, kind: str, make: Callable[..., DataFrame], needs: tuple[str, ...] = (), output: bool = False) -> PlanGraph:
        if name in self.nodes:
            raise ValueError(f"{name} is there already")
        self.nodes[name] = Node(name, kind, make, needs, output)
        return self

    def levels(self) -> list[list[str]]:
        """Nodes by longest distance from a source; raises on a cycle or an unknown dependency."""
        if missing := {d for n in self.nodes.values() for d in n.needs} - set(self.nodes):
            raise ValueError(f"unknown nodes: {sorted(missing)}")
        left, done, out = dict(self.nodes), set(), []
        while left:
            ready = [k for k, n in left.items() if set(n.needs) <= done]
            if not ready:
                raise ValueError(f"a cycle through {sorted(left)}")
            out.append(ready)
            done |= set(ready)
            for k in ready:
                del left[k]
        return out

    def live(self) -> set[str]:
        """Nodes that an output needs."""
        found, todo = set(), [n.name for n in self.nodes.values() if n.output]
        while todo:
            if (k := todo.pop()) not in found:
                found.add(k)
                todo += self.nodes[k].needs
        return found

    def fused(self) -> list[tuple[str, str]]:
        """Pairs of transforms that one stage of generated code runs: a transform whose one dependency is a transform that nothing else reads."""
        live = self.live()
        readers = {k: [n.name for n in self.nodes.values() if k in n.needs and n.name in live] for k in live}
        n = self.nodes
        return [(n[k].needs[0], k) for level in self.levels() for k in level if k in live and n[k].kind == "transform" and len(n[k].needs) == 1 and n[n[k].needs[0]].kind == "transform" and not n[n[k].needs[0]].output and readers[n[k].needs[0]] == [k]]

    def execute(self) -> dict[str, DataFrame]:
        """The outputs, as plans; nodes that no output needs aren't made."""
        live, made = self.live(), {}
        for level in self.levels():
            for k in level:
                if k in live:
                    made[k] = self.nodes[k].make(*[made[d] for d in self.nodes[k].needs])
        return {k: made[k] for k, n in self.nodes.items() if n.output}

    def timed(self) -> dict[str, float]:
        """Seconds that each live node's plan takes when run alone (nodes upstream included)."""
        live, made, took = self.live(), {}, {}
        for level in self.levels():
            for k in level:
                if k in live:
                    made[k] = self.nodes[k].make(*[made[d] for d in self.nodes[k].needs])
                    began = time.perf_counter()
                    made[k].write.format("noop").mode("overwrite").save()
                    took[k] = time.perf_counter() - began
        return took

    def trace_json(self, took: dict[str, float]) -> str:
        """The nodes' seconds as complete events (microseconds) of the trace format that browsers show: one track a level, each level begins when the one before has ended."""
        events, began = [], 0.0
        for track, level in enumerate(self.levels()):
            ran = [k for k in level if k in took]
            for k in ran:
                events.append({"name": k, "cat": self.nodes[k].kind, "ph": "X", "ts": round(began * 1e6), "dur": round(took[k] * 1e6), "pid": 1, "tid": track})
                began += took[k]
        return json.dumps({"traceEvents": events, "displayTimeUnit": "ms"})

    def critical_path(self, took: dict[str, float]) -> tuple[list[str], float]:
        """The chain of nodes with most time."""
        best: dict[str, tuple[float, list[str]]] = {}
        for level in self.levels():
            for k in level:
                before = max((best[d] for d in self.nodes[k].needs), default=(0.0, []), key=lambda x: x[0])
                best[k] = (before[0] + took.get(k, 0.0), [*before[1], k])
        total, path = max(best.values(), key=lambda x: x[0], default=(0.0, []))
        return path, total

    def fingerprint(self) -> int:
        """Of names, kinds, outputs and edges."""
        shape = [[n.name, n.kind, n.name in self.live(), list(n.needs)] for n in self.nodes.values()]
        return fnv1a(json.dumps(shape, sort_keys=True).encode())


def checksum(df: DataFrame) -> int:
    """Of the rows in any order, bit-exact in doubles; one aggregation."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    first = df.agg(F.sum(row.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return fnv1a(f"{first['s']}/{first['n']}".encode())


@dataclass
class Manifest:
    """What a run made: outputs' checksums under the graph's fingerprint. Seconds are kept but never compared."""

    run_id: str
    graph: int
    outputs: dict[str, int]
    seconds: float = 0.0

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))


def run_manifest(graph: PlanGraph, run_id: str) -> Manifest:
    began = time.perf_counter()
    outputs = {k: checksum(df) for k, df in graph.execute().items()}
    return Manifest(run_id, graph.fingerprint(), outputs, time.perf_counter() - began)


def verify(recorded: Manifest, again: Manifest) -> dict:
    """graph_matches, outputs_match and the names that diverged."""
    names = sorted(set(recorded.outputs) | set(again.outputs))
    diverged = [k for k in names if recorded.outputs.get(k) != again.outputs.get(k)]
    return {"graph_matches": recorded.graph == again.graph, "outputs_match": not diverged, "diverged": diverged}
