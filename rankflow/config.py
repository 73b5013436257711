"""Run description and balancing parameters, from Python or YAML."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace
from enum import Enum


class Criterion(Enum):
    Grapevine = "Grapevine"
    ModifiedGrapevine = "ModifiedGrapevine"


class Ordering(Enum):
    Arbitrary = "Arbitrary"
    ElmID = "ElmID"
    FewestMigrations = "FewestMigrations"
    SmallObjects = "SmallObjects"
    LargestObjects = "LargestObjects"


class CMF(Enum):
    Original = "Original"
    NormByMax = "NormByMax"
    NormByMaxExcludeIneligible = "NormByMaxExcludeIneligible"


class Algorithm(Enum):
    TemperedLB = "TemperedLB"
    NoLB = "None"


@dataclass(frozen=True)
class MemoryInfo:
    has_mem_info: bool = True
    has_task_serialized_mem_info: bool = True
    has_task_working_mem_info: bool = True
    has_task_footprint_mem_info: bool = True
    has_shared_block_mem_info: bool = True

    def on(self, name: str) -> bool:
        """A kind of memory counts only where memory counts at all."""
        return self.has_mem_info and getattr(self, name)


@dataclass(frozen=True)
class WorkModel:
    rank_alpha: float = 1.0
    beta: float = 0.0
    gamma: float = 0.0
    delta: float = 0.0
    memory: MemoryInfo = field(default_factory=MemoryInfo)

    @property
    def by_clusters(self) -> bool:
        """Communication or sharing costs something, so whole clusters move."""
        return bool(self.beta or self.gamma or self.delta)


@dataclass(frozen=True)
class BalanceConfig:
    num_trials: int = 1
    num_iters: int = 10
    fanout: int = 2
    n_rounds: int = 1
    deterministic: bool = True
    seed: int = 29
    converge_tolerance: float = 0.01
    criterion: Criterion = Criterion.ModifiedGrapevine
    obj_ordering: Ordering = Ordering.ElmID
    cmf_type: CMF = CMF.Original
    based_on_shared_blocks: bool = False
    based_on_communication: bool = False
    visualize_task_graph: bool = False
    visualize_clusters: bool = False
    visualize_full_graph: bool = False
    work: WorkModel = field(default_factory=WorkModel)
    #: Draw of deterministic mode: the first number of the standard 64-bit Mersenne stream at its default seed.
    draw: float = 0.1354770042967805

    @staticmethod
    def for_ranks(n: int) -> BalanceConfig:
        return BalanceConfig(fanout=2, n_rounds=math.ceil(math.sqrt(math.log2(n))) if n > 1 else 0)


@dataclass(frozen=True)
class RunSpec:
    data_folder: str
    phase_id: int
    algorithm: Algorithm
    config: BalanceConfig


class ConfigError(RuntimeError):
    """A missing, unknown or badly typed entry."""


def _typed(where: str, value, kind):
    if isinstance(kind, type) and issubclass(kind, Enum):
        try:
            return kind(str(value))
        except ValueError:
            raise ConfigError(f"{where}: unknown value {value!r}") from None
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(f"{where}: {value!r} is no {kind.__name__}")
    return value


def _update(target, given, where: str):
    """Known keys replace the defaults; unknown ones are ignored."""
    if given is None:
        return target
    if not isinstance(given, dict):
        raise ConfigError(f"{where} is no mapping")
    known = {f.name: type(getattr(target, f.name)) for f in fields(target)}
    return replace(target, **{k: _typed(f"{where}.{k}", v, known[k]) for k, v in given.items() if k in known and known[k] in (int, bool, float, Criterion, Ordering, CMF)})


def balance_config(document: dict, n_ranks: int) -> BalanceConfig:
    """The `configuration` section over the defaults for a number of ranks."""
    section = document.get("configuration") or {}
    config = _update(BalanceConfig.for_ranks(n_ranks), section, "configuration")
    for part in ("transfer_decisions", "clustering"):
        config = _update(config, section.get(part), part)
    work = section.get("work_model") or {}
    model = _update(WorkModel(), work.get("parameters"), "work_model.parameters")
    return replace(config, work=replace(model, memory=_update(MemoryInfo(), work.get("memory_info"), "work_model.memory_info")))


def run_spec(text: str, n_ranks: int) -> RunSpec:
    """A whole YAML run description."""
    import yaml

    try:
        document = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from None
    data = document.get("from_data") or {}
    for key in ("data_folder", "phase_id"):
        if key not in data:
            raise ConfigError(f"from_data.{key} is missing")
    if "algorithm" not in document:
        raise ConfigError("algorithm is missing")
    return RunSpec(_typed("data_folder", data["data_folder"], str), _typed("phase_id", data["phase_id"], int), _typed("algorithm", document["algorithm"], Algorithm), balance_config(document, n_ranks))


def run_spec_file(path: str, n_ranks: int) -> RunSpec:
    """A run description in a file that the driver can read."""
    try:
        with open(path, encoding="utf-8") as f:
            return run_spec(f.read(), n_ranks)
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from None
