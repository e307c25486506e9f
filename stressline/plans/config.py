"""Settings: a YAML file over typed defaults, and a hash of the outcome."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml

from stressline.operators.features import FeatureWindows
from stressline.plans.walk_forward import WalkForwardConfig


@dataclass(frozen=True)
class DataConfig:
    primary: str = "IDX"
    optional: tuple[str, ...] = ()
    lags: Mapping[str, int] = field(default_factory=dict)
    min_volume_coverage: float = 0.90
    max_fill: int = 3


@dataclass(frozen=True)
class EngineConfig:
    data: DataConfig = field(default_factory=DataConfig)
    features: FeatureWindows = field(default_factory=FeatureWindows)
    walk: WalkForwardConfig = field(default_factory=WalkForwardConfig)


def _build(cls: type, given: Mapping | None):
    given = dict(given or {})
    names = {f.name for f in dataclasses.fields(cls)}
    if unknown := set(given) - names:
        raise ValueError(f"unknown settings of {cls.__name__}: {sorted(unknown)}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load_config(path: str | None = None) -> EngineConfig:
    raw = {}
    if path:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    if unknown := set(raw) - {"data", "features", "walk"}:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return EngineConfig(_build(DataConfig, raw.get("data")), _build(FeatureWindows, raw.get("features")), _build(WalkForwardConfig, raw.get("walk")))


def config_hash(config: EngineConfig) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True, default=str).encode()).hexdigest()
