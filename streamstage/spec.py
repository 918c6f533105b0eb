"""Pipeline files: YAML to a checked PipelineSpec."""

from __future__ import annotations

from dataclasses import dataclass, field as dataclass_field
from pathlib import Path
from typing import Any

import yaml

from streamstage.types import EVENT, Record, missing_fields


class SpecError(ValueError):
    """A pipeline file that can't be used, and why."""


@dataclass(frozen=True)
class Scaling:
    min_replicas: int = 0
    max_replicas: int = 2
    queue_up: float = 50.0
    queue_down: float = 0.0
    cooldown_up_s: float = 0.1
    cooldown_down_s: float = 5.0
    p99_ms: float = 50.0


@dataclass(frozen=True)
class Node:
    name: str
    host: str = "127.0.0.1"
    force_tcp: bool = False


@dataclass(frozen=True)
class Stage:
    name: str
    input_type: str
    output_type: str
    src: str | None
    binary: str | None
    scaling: Scaling
    placement: str
    deps: dict[str, Any]


@dataclass(frozen=True)
class Source:
    kind: str
    params: dict[str, Any]


@dataclass(frozen=True)
class PipelineSpec:
    package: str
    nodes: tuple[Node, ...]
    this_host: str
    stages: tuple[Stage, ...]
    edges: tuple[tuple[str, str], ...]
    ingress: str
    collector: str
    port_base: int
    host: str
    types: dict[str, Record]
    source: Source | None
    resource_sample_interval_ms: int
    credit_window: int
    warnings: tuple[str, ...] = dataclass_field(default=())

    def record(self, name: str) -> Record:
        return self.types.get(name) or EVENT

    def ordered(self) -> list[Stage]:
        """The stages along the edges; an error unless these form one line."""
        follows = dict(self.edges)
        heads = [s.name for s in self.stages if s.name not in {b for _, b in self.edges}]
        if len(follows) != len(self.edges) or len({b for _, b in self.edges}) != len(self.edges) or len(heads) != 1:
            raise SpecError("only linear pipelines are supported: each stage has one predecessor and one successor at most")
        by_name, line = {s.name: s for s in self.stages}, [heads[0]]
        while line[-1] in follows:
            line.append(follows[line[-1]])
        if len(line) != len(self.stages):
            raise SpecError("only linear pipelines are supported: some stages aren't reached")
        return [by_name[x] for x in line]

    def here(self) -> list[Stage]:
        """The stages placed on this host; an error if there are none."""
        found = [s for s in self.ordered() if s.placement == self.this_host]
        if not found:
            raise SpecError(f"no stage is placed on {self.this_host!r}")
        return found


#: What a file may say without any effect here.
UNREAD = {"p99_ms", "replica_capacity_eps", "calm_window"}
SCALING_KEYS = {"min": "min_replicas", "max": "max_replicas"} | {k: k for k in ("queue_up", "queue_down", "cooldown_up_s", "cooldown_down_s", "p99_ms")}


def load(path: str | Path) -> PipelineSpec:
    """Read a pipeline file of the present form (stages, types) or the old one (pipeline, dispatchers)."""
    path = Path(path)
    try:
        raw = yaml.safe_load(path.read_text())
    except yaml.YAMLError as e:
        raise SpecError(f"{path}: not YAML: {e}") from e
    if not isinstance(raw, dict):
        raise SpecError(f"{path}: not a mapping")
    return _present(raw, path.parent) if "stages" in raw or "types" in raw else _old(raw, path.parent)


def _scaling(raw: dict[str, Any], names: dict[str, str]) -> Scaling:
    return Scaling(**{names[k]: v for k, v in raw.items() if k in names and v is not None})


def _checked_deps(stage: str, deps: dict[str, Any]) -> dict[str, Any]:
    """A dependency is a version or a table of settings; lists only within a table."""
    for name, value in deps.items():
        if value is None or isinstance(value, list):
            raise SpecError(f"stage {stage}: dependency {name} must be a version or a table")
        if isinstance(value, dict) and any(v is None for v in value.values()):
            raise SpecError(f"stage {stage}: dependency {name} has an empty setting")
    return deps


def _present(raw: dict[str, Any], folder: Path) -> PipelineSpec:
    if not raw.get("stages"):
        raise SpecError("pipeline has no stages")
    deploy = raw.get("deploy") or {}
    nodes = tuple(Node(n["name"], n.get("host", "127.0.0.1"), bool(n.get("force_tcp", False))) for n in raw.get("nodes") or ()) or (Node("local", deploy.get("host") or "127.0.0.1"),)
    names = {n.name for n in nodes}
    stages, warnings = [], []
    for s in raw["stages"]:
        name, src, binary = s["name"], s.get("src"), s.get("wasm")
        if src and binary:
            raise SpecError(f"stage {name} has both `src` and `wasm`; pick one")
        if not src and not binary:
            raise SpecError(f"stage {name} has neither `src` nor `wasm`; one is required")
        if src and ":" not in src and not (folder / src).exists():
            raise SpecError(f"stage {name}: src file not found: {folder / src}")
        placement = s.get("placement") or nodes[0].name
        if placement not in names:
            raise SpecError(f"stage {name}: placement {placement!r} does not match any declared node")
        scaling = s.get("scaling") or {}
        warnings += [f"stage {name}: {k} has no effect" for k in scaling if k in UNREAD]
        stages.append(Stage(name, s.get("in", "event"), s.get("out", "event"), src, binary, _scaling(scaling, SCALING_KEYS), placement, _checked_deps(name, s.get("deps") or {})))
    edges = []
    for e in raw.get("edges") or ():
        ends = [x.strip() for x in str(e).split("->")]
        if len(ends) != 2 or not all(ends):
            raise SpecError(f"bad edge spec {e!r}; expected 'from -> to'")
        edges.append((ends[0], ends[1]))
    edges = edges or [(a.name, b.name) for a, b in zip(stages, stages[1:], strict=False)]
    by_name = {s.name: s for s in stages}
    for a, b in edges:
        if a not in by_name:
            raise SpecError(f"edge source {a!r} is not a declared stage")
        if b not in by_name:
            raise SpecError(f"edge target {b!r} is not a declared stage")
    types = {k: Record.of(k, v or {}) for k, v in (raw.get("types") or {}).items()}
    for a, b in edges:
        out, into = by_name[a].output_type, by_name[b].input_type
        if out != into:
            raise SpecError(f"edge {a} -> {b} type mismatch: {a!r} produces `{out}`, but {b!r} consumes `{into}`")
        if types and out not in types:
            raise SpecError(f"stage {a!r} declares out: {out!r}, but no such type in `types:`")
        if types and (wrong := missing_fields(types[out], types[into])):
            raise SpecError(f"edge {a} -> {b}: {'; '.join(wrong)}")
    this_host = deploy.get("this_host") or nodes[0].name
    if this_host not in names:
        raise SpecError(f"this_host {this_host!r} does not match any declared node")
    if not deploy.get("ingress"):
        raise SpecError("deploy.ingress is required: declare where events enter the pipeline")
    source = raw.get("source")
    return PipelineSpec(
        raw.get("package", "streamstage:pipeline@0.1.0"), nodes, this_host, tuple(stages), tuple(edges), deploy["ingress"], deploy.get("collector", "tcp://localhost:9999"), int(deploy.get("port_base", 9000)),
        deploy.get("host", "localhost"), types, Source(source["kind"], {k: v for k, v in source.items() if k != "kind"}) if source else None,
        int(deploy.get("resource_sample_interval_ms", 1000)), int(deploy.get("credit_window", 1)), tuple(warnings),
    )


def _old(raw: dict[str, Any], folder: Path) -> PipelineSpec:
    if not raw.get("pipeline"):
        raise SpecError("pipeline has no stages")
    keys = {"min_replicas": "min_replicas", "max_replicas": "max_replicas"} | {k: k for k in ("queue_up", "queue_down", "cooldown_up_s", "cooldown_down_s", "p99_ms")}
    stages = []
    for s in raw["pipeline"]:
        if not s.get("wasm"):
            raise SpecError(f"old-format stage {s.get('name')} missing `wasm` field")
        stages.append(Stage(s["name"], "event", "event", None, s["wasm"], _scaling(s.get("slo") or {}, keys), "local", {}))
    dispatchers, sinks = raw.get("dispatchers") or [], raw.get("sinks") or []
    base = min((min(d["ctrl_port"], d["push_port"], d["pull_port"]) for d in dispatchers), default=9000)
    return PipelineSpec(
        "streamstage:legacy@0.1.0", (Node("local"),), "local", tuple(stages), tuple((a.name, b.name) for a, b in zip(stages, stages[1:], strict=False)),
        f"tcp://localhost:{dispatchers[0]['push_port'] if dispatchers else base}", f"tcp://localhost:{sinks[0]['push_port']}" if sinks else "tcp://localhost:9999", base, "localhost", {}, None, 1000, 1,
    )


def queue_params(path: str | Path) -> dict[str, dict[str, float | int]]:
    """Each stage's queue_up, queue_down, min_rep and max_rep, from a file of which nothing else need be right: defaults
    for what a stage leaves out, stages without any scaling left out."""
    try:
        raw = yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as e:
        raise SpecError(f"{path}: not YAML: {e}") from e
    stages = raw.get("stages") if isinstance(raw, dict) else None
    out: dict[str, dict[str, float | int]] = {}
    for s in stages if isinstance(stages, list) else ():
        scaling = s.get("scaling") if isinstance(s, dict) else None
        if isinstance(scaling, dict) and scaling and s.get("name"):
            get = lambda k, default, kind: kind(scaling.get(k, default))  # noqa: B023, E731
            out[str(s["name"])] = {"queue_up": get("queue_up", 50, float), "queue_down": get("queue_down", 0, float), "min_rep": get("min", 1, int), "max_rep": get("max", 8, int)}
    return out


def endpoints(spec: PipelineSpec) -> dict[str, dict[str, int]]:
    """Ports of each stage, three in a row from ``port_base``. Informational: Spark needs none."""
    return {s.name: {"push": spec.port_base + 3 * i, "pull": spec.port_base + 3 * i + 1, "ctrl": spec.port_base + 3 * i + 2} for i, s in enumerate(spec.ordered())}


def tee_address(collector: str) -> str:
    """Where copies of finished events go: the next port, or the path with ``-pub``."""
    if collector.startswith("tcp://"):
        host, _, port = collector.rpartition(":")
        return f"{host}:{int(port) + 1}"
    return f"{collector}-pub"
