"""Settings of the detectors, in seconds and counts."""

from __future__ import annotations

import dataclasses
import hashlib
import json


@dataclasses.dataclass(frozen=True)
class Grammar:
    """Defaults that the detectors' results depend on."""

    min_isi: float = 0.0009
    seed_low: float = 0.001
    seed_high: float = 0.01
    bridge: float = 0.015
    contrast: float = 2.5
    possible_contrast: float = 2.0
    one_sided_extra: float = 0.5
    min_seeds: int = 2
    max_bridges: int = 4
    max_bridge_share: float = 0.6
    max_extension: int = 4
    #: Burst candidates of a train; none is left out by default, the reference has 3000.
    max_candidates: int | None = None
    one_sided_purity: float = 0.65
    one_sided_bridge_share: float = 0.35
    q95_limit: float = 1.35
    strict_q95: bool = False
    min_spikes: int = 3
    classic_spikes: int = 10
    long_spikes: tuple[int, int] = (11, 15)
    rescue_ratio: float = 3.0
    strong_rescue_ratio: float = 4.0
    rescue_purity: float = 0.7
    rescue_cv: float = 0.8
    episode_bridge_factor: float = 1.75
    episode_background: float = 0.35
    episode_min_isi: int = 3
    episode_seed_share: float = 0.18
    episode_low_share: float = 0.85
    episode_cv: float = 0.55
    episode_spikes: int = 20
    hfs_short: float = 0.02
    hfs_q80: float = 0.025
    hfs_q90: float = 0.025
    hfs_bridge: float = 0.035
    hfs_tolerated: float = 0.075
    hfs_large_share: float = 0.3
    hfs_gap: int = 3
    #: Intervals as long as this, or as the pause or the greatest interval of the state (null: none), part a state whatever stands around them.
    hfs_break: float = 0.0375
    hfs_max: float | None = None
    hfs_spikes: int = 30
    hft_floor: float = 0.01
    hft_max: float = 0.03
    hft_low_share: float = 0.05
    hft_spikes: int = 6
    hft_cv: float = 0.6
    hft_lv: float = 0.6
    hft_mm: float = 2.0
    tonic_min: float = 0.02
    tonic_max: float = 0.06
    tonic_spikes: int = 5
    tonic_lv: float = 0.5
    tonic_mm: tuple[float, float] = (0.85, 1.25)
    tonic_calm_mm: float = 1.4
    tonic_guard: float = 1.15
    tonic_low_share: float = 0.05
    pause_min: float = 0.1
    pause_local: float = 1.55
    pause_global: float = 1.25

    def digest(self) -> str:
        """SHA-256 of the settings as canonical JSON."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()

    def flat(self) -> list[tuple[str, str]]:
        return sorted((k, json.dumps(v)) for k, v in dataclasses.asdict(self).items())

    def issues(self) -> list[str]:
        """What is wrong with the settings."""
        found = [f"{k} is negative" for k, v in dataclasses.asdict(self).items() if isinstance(v, (int, float)) and v < 0]
        found += ["seed_high isn't over seed_low"] * (self.seed_high <= self.seed_low) + ["bridge is under seed_high"] * (self.bridge < self.seed_high)
        return found

    def text(self) -> str:
        """The settings as JSON, which from_text() reads back to equal ones."""
        return json.dumps(dataclasses.asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_text(cls, text: str, strict: bool = True) -> Grammar:
        """Settings from JSON: what it leaves out keeps its default, unknown names raise unless strict is off, and so do values of another kind than the default's."""
        given = json.loads(text)
        for f in dataclasses.fields(cls):
            value, default = given.get(f.name), f.default
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            fits = isinstance(value, bool) if isinstance(default, bool) else number if isinstance(default, (int, float)) else isinstance(value, list) if isinstance(default, tuple) else True
            if f.name in given and not fits:
                raise ValueError(f"{f.name}: {value!r} is no value for it")
        return cls.from_dict(given, strict)

    @classmethod
    def from_dict(cls, values: dict, strict: bool = True) -> Grammar:
        known = {f.name: f for f in dataclasses.fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown and strict:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})
