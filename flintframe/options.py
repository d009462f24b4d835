"""Options of a run: typed, explicit, with the defaults of each section; from a file, or from arguments over one."""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Preprocessing:
    """grey: standard, clahe or off; normalise: minmax, zscore or off; threshold: otsu, simple, default or adaptive.

    blur, block (of the adaptive threshold) and closing are sizes at the reference resolution; closing 0 is none.
    """

    grey: str = "standard"
    normalise: str = "minmax"
    clip: tuple[int, int] = (0, 255)
    blur: int = 5
    block: int = 11
    threshold: str = "otsu"
    threshold_at: int = 127
    closing: int = 3


@dataclass(frozen=True)
class Filtering:
    exclude_border: bool = True
    min_area: float = 50.0


@dataclass(frozen=True)
class Classification:
    enabled: bool = True
    tolerance: float = 0.1


@dataclass(frozen=True)
class Cortex:
    enabled: bool = True
    sensitivity: str = "medium"


@dataclass(frozen=True)
class Scars:
    enabled: bool = True
    distance_threshold: float = 10.0


@dataclass(frozen=True)
class Scale:
    enabled: bool = True
    ink: int = 127


@dataclass(frozen=True)
class Arrows:
    enabled: bool = True
    solidity: tuple[float, float] = (0.4, 1.0)
    #: Of contours inside none of the features' children, before they are looked at as arrows.
    free_solidity: tuple[float, float] = (0.4, 0.9)


@dataclass(frozen=True)
class Dpi:
    enabled: bool = False
    reference: float = 300.0
    mode: str = "conservative"
    most: float = 3.0


@dataclass(frozen=True)
class Options:
    """All sections. legacy_pixel_units keeps pixels where a scale bar would give millimetres."""

    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    filtering: Filtering = field(default_factory=Filtering)
    classification: Classification = field(default_factory=Classification)
    cortex: Cortex = field(default_factory=Cortex)
    scars: Scars = field(default_factory=Scars)
    scale: Scale = field(default_factory=Scale)
    arrows: Arrows = field(default_factory=Arrows)
    dpi: Dpi = field(default_factory=Dpi)
    json_per_lithic: bool = True
    legacy_pixel_units: bool = False

    def update(self, **values: Any) -> Options:
        """A copy with values set; ``section__name`` sets a value in a section. Unknown names fail."""
        out = self
        for key, value in values.items():
            section, _, name = key.partition("__")
            if section not in {f.name for f in fields(self)}:
                raise KeyError(key)
            out = replace(out, **{section: replace(getattr(out, section), **{name: value}) if name else value})
        return out

    @classmethod
    def from_dict(cls, given: dict[str, Any]) -> Options:
        """Options from nested values over the defaults; sections and names that are not known fail."""
        flat = {f"{s}__{k}": x for s, v in given.items() if isinstance(v, dict) for k, x in v.items()}
        return cls().update(**flat, **{s: v for s, v in given.items() if not isinstance(v, dict)})

    @classmethod
    def load(cls, path: str | None = None) -> Options:
        """Options from a JSON or YAML file: the path, else the one that FLINTFRAME_CONFIG names, else defaults.

        Missing sections and values have their defaults; with a file that can't be read or has unknown names, all have.
        """
        path = path or os.environ.get("FLINTFRAME_CONFIG")
        if not path:
            return cls()
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            return cls.from_dict(_parsed(text, path) or {})
        except (OSError, ValueError, KeyError, TypeError) as e:
            logging.warning("options of %s not used: %s", path, e)
            return cls()


def _parsed(text: str, path: str) -> dict[str, Any]:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML files need a YAML package; JSON does not") from e
        return yaml.safe_load(text)
    return json.loads(text)


def parser() -> argparse.ArgumentParser:
    """Arguments of a run; those that are given go over the file's values."""
    p = argparse.ArgumentParser(prog="flintframe", description="Measures of drawings of stone artefacts")
    p.add_argument("--data_dir", required=True, help="folder with images/ and, if scales are used, scales/")
    p.add_argument("--meta_file", required=True, help="CSV with image_id, scale_id, scale")
    p.add_argument("--output_dir", help="folder of the results; processed/ in the data folder if not given")
    p.add_argument("--config_file")
    p.add_argument("--resume", action="store_true", help="leave what is measured already and add the rest")
    p.add_argument("--parts", type=int, default=1, help="with --resume: in so many parts, each saved before the next")
    p.add_argument("--threshold_method", choices=["adaptive", "simple", "otsu", "default"])
    p.add_argument("--no_closing", action="store_true")
    p.add_argument("--enable_dpi_scaling", action="store_true")
    p.add_argument("--dpi_reference", type=float)
    p.add_argument("--dpi_max_scale", type=float)
    p.add_argument("--dpi_scaling_mode", choices=["conservative", "standard", "aggressive"])
    p.add_argument("--disable_arrow_detection", action="store_true")
    p.add_argument("--disable_scale_calibration", action="store_true")
    p.add_argument("--force_pixels", action="store_true")
    p.add_argument("--disable_cortex_detection", action="store_true")
    p.add_argument("--cortex_sensitivity", choices=["low", "medium", "high"])
    p.add_argument("--disable_scar_complexity", action="store_true")
    p.add_argument("--scar_distance", type=float)
    p.add_argument("--disable_json", action="store_true")
    return p


def from_arguments(given: argparse.Namespace) -> Options:
    """Options from parsed arguments over the file that they name."""
    values = {
        "preprocessing__threshold": given.threshold_method, "preprocessing__closing": 0 if given.no_closing else None,
        "dpi__enabled": True if given.enable_dpi_scaling else None, "dpi__reference": given.dpi_reference, "dpi__most": given.dpi_max_scale, "dpi__mode": given.dpi_scaling_mode,
        "arrows__enabled": False if given.disable_arrow_detection else None, "scale__enabled": False if given.disable_scale_calibration or given.force_pixels else None,
        "cortex__enabled": False if given.disable_cortex_detection else None, "cortex__sensitivity": given.cortex_sensitivity,
        "scars__enabled": False if given.disable_scar_complexity else None, "scars__distance_threshold": given.scar_distance, "json_per_lithic": False if given.disable_json else None,
    }
    return Options.load(given.config_file).update(**{k: v for k, v in values.items() if v is not None})
