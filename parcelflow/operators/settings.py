"""Settings of the detector, read from options with bounds."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


def _number(text: str | None) -> float | None:
    try:
        x = float(text) if text not in (None, "") else math.nan
    except ValueError:
        return None
    return x if math.isfinite(x) else None


@dataclass(frozen=True)
class Settings:
    """The defaults. Whole numbers have a least value (LEAST), shares lie in 0..1."""

    tile_size: int = 768
    tile_overlap: int = 32
    closing_m: float = 0.45
    opening_m: float = 0.25
    displacement_m: float = 0.6
    hole_m2: float = 4.0
    max_morphology: int = 4
    max_displacement: int = 4
    fallback_area: int = 512
    known_area: int = 4
    min_area_m2: float = 6.0
    ssim_radius: int = 5
    displacement: int = 2
    multiscale: int = 9
    color: float = 0.45
    structure: float = 0.40
    texture: float = 0.15
    removal: float = 0.28
    high_floor: int = 24
    low_floor: int = 10
    high_ceiling: int = 220
    high_mads: int = 6
    low_mads: int = 3
    low_share: float = 0.45
    max_gradient: int = 38
    max_registration: int = 88
    max_structure: int = 150
    max_color: int = 54
    stable_share: float = 0.06
    stable_pixels: int = 5000
    tail_mads: float = 4.5
    seed_share: float = 0.012
    cells: int = 4
    local_high: float = 1.35
    local_low: float = 0.72
    grid: int = 4
    max_edge_residual: float = 0.62
    edge_gradient: int = 42
    edges_per_cell: int = 120
    clip: float = 0.02
    samples: int = 100_000
    radiometric_gradient: int = 42
    provisional: float = 0.8
    min_gain: float = 0.65
    max_gain: float = 1.55
    annulus: int = 8
    low_only_pixels: int = 72
    low_only_checks: int = 4
    accept: float = 0.82
    max_changed: float = 0.1
    max_edge_only: float = 0.12
    max_raw_residual: int = 58
    max_ui: float = 0.12
    band_coverage: float = 0.35
    band_thickness: float = 0.3
    band_residual: int = 20
    band_gradient: int = 32
    regions: int = 18


LEAST = {"tile_size": 256, "tile_overlap": 8, "ssim_radius": 1, "multiscale": 2, "stable_pixels": 100, "cells": 2, "grid": 2, "samples": 1000, "annulus": 2, "low_only_pixels": 8, "low_only_checks": 2}


def from_options(options: Mapping[str, str], base: Settings = Settings()) -> Settings:
    """base with what options name; text that is no finite number leaves the default; numbers are brought into bounds."""
    out = {}
    for f in fields(Settings):
        x = _number(options.get(f.name))
        if x is None:
            continue
        default = getattr(base, f.name)
        if isinstance(default, int):
            out[f.name] = max(LEAST.get(f.name, 0), math.floor(x + 0.5))
        else:
            out[f.name] = max(0.0, min(1.0, x) if default < 1 else x)
    return replace(base, **out)


def scale_parameters(mpp: float | None, s: Settings = Settings()) -> dict[str, int | bool]:
    """Radii and areas in pixels from metres; without a known scale the fallbacks."""
    if not mpp or not mpp > 0:
        return {"known": False, "closing": 1, "opening": 1, "displacement": s.displacement, "hole": 16}
    radius = lambda metres, most: min(most, max(0, math.floor(metres / max(0.001, mpp) + 0.5)))
    return {
        "known": True, "closing": radius(s.closing_m, s.max_morphology), "opening": radius(s.opening_m, s.max_morphology),
        "displacement": radius(s.displacement_m, s.max_displacement), "hole": max(1, math.floor(s.hole_m2 / mpp**2 + 0.5)),
    }


def minimum_area(mpp: float | None, shrunk: float = 1.0, s: Settings = Settings()) -> int:
    """The least area of a component in pixels; shrunk: native pixels a pixel's side stands for."""
    if not mpp or not mpp > 0:
        return s.fallback_area
    return max(s.known_area, math.ceil(s.min_area_m2 / (mpp * max(1.0, shrunk)) ** 2))
