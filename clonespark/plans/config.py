"""Run configuration: one nested record with defaults, read from JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from ..operators.chimera import ChimeraOptions
from ..operators.denoise import DenoiseOptions
from ..operators.lineages import LineageOptions
from ..operators.missing import MissingOptions
from ..operators.quality import QualityOptions
from ..operators.refinement import RefinementOptions
from ..operators.selection import Selection


@dataclass(frozen=True)
class CollapseStage:
    enabled: bool = True
    mode: str = "exact"  # or conservative, indel, abundance
    key: str = "trimmed"
    scope: str = "sample"
    unresolved: str = "discard"
    respect_constant: bool = True
    denoise: DenoiseOptions = field(default_factory=DenoiseOptions)


@dataclass(frozen=True)
class ChimeraStage:
    enabled: bool = False
    options: ChimeraOptions = field(default_factory=ChimeraOptions)


@dataclass(frozen=True)
class SelectionStage:
    enabled: bool = False
    options: Selection = field(default_factory=Selection)


@dataclass(frozen=True)
class RefinementStage:
    enabled: bool = False
    segments: tuple[str, ...] = ("V", "J")
    policy: str = "confidence"
    minimum_posterior: float = 0.8
    options: RefinementOptions = field(default_factory=RefinementOptions)


@dataclass(frozen=True)
class LineageStage:
    enabled: bool = True
    options: LineageOptions = field(default_factory=LineageOptions)


@dataclass(frozen=True)
class ShmStage:
    enabled: bool = True
    metric: str = "v_nt_rate"


@dataclass(frozen=True)
class MissingStage:
    enabled: bool = False
    options: MissingOptions = field(default_factory=MissingOptions)


@dataclass(frozen=True)
class StudyConfig:
    name: str = "study"
    quality: QualityOptions = field(default_factory=QualityOptions)
    refinement: RefinementStage = field(default_factory=RefinementStage)
    collapse: CollapseStage = field(default_factory=CollapseStage)
    chimera: ChimeraStage = field(default_factory=ChimeraStage)
    selection: SelectionStage = field(default_factory=SelectionStage)
    lineage: LineageStage = field(default_factory=LineageStage)
    shm: ShmStage = field(default_factory=ShmStage)
    missing: MissingStage = field(default_factory=MissingStage)


def _build(cls, values: dict, where: str):
    known = {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"Unknown setting {where}{unknown[0]}.")
    default = cls()
    arguments = {}
    for name, value in values.items():
        current = getattr(default, name)
        if dataclasses.is_dataclass(current):
            arguments[name] = _build(type(current), value, f"{where}{name}.")
        else:
            arguments[name] = tuple(value) if isinstance(current, tuple) else value
    return cls(**arguments)


def load_config(text: str) -> StudyConfig:
    """Parse a JSON configuration; anything absent keeps its default."""
    return _build(StudyConfig, json.loads(text), "")


def dump_config(config: StudyConfig) -> str:
    return json.dumps(dataclasses.asdict(config), sort_keys=True, indent=2)
