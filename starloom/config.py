"""Settings of a run: defaults, YAML or JSON files over them, and the rules that they must keep."""

from __future__ import annotations

import copy
import json

# fixed values: names, defaults and allowed ranges of the settings
DEFAULTS: dict[str, dict[str, object]] = {
    "pipeline": {"mode": "production"},
    "data": {"image_width": 0, "image_height": 0, "frames_min": 50, "color_mode": "OSC", "bayer_pattern": "GBRG", "linear_required": True},
    "linearity": {"enabled": True, "max_frames": 8, "min_overall_linearity": 0.9, "strictness": "strict"},
    "assumptions": {"pipeline_profile": "practical", "frames_min": 50, "frames_optimal": 800, "frames_reduced_threshold": 200, "exposure_time_tolerance_percent": 5.0, "reduced_mode_cluster_range": [5, 10]},
    "normalization": {"enabled": True, "mode": "background", "per_channel": True},
    "registration": {"star_topk": 120, "allow_rotation": True},
    "global_metrics": {"weights": {"background": 0.4, "noise": 0.3, "gradient": 0.3}, "clamp": [-3.0, 3.0], "adaptive_weights": False, "weight_exponent_scale": 1.0},
    "tile": {"size_factor": 32.0, "min_size": 64, "max_divisor": 6, "overlap_fraction": 0.25, "star_min_count": 10},
    "stacking": {"method": "rej", "sigma_clip": {"sigma_low": 2.0, "sigma_high": 2.0, "max_iters": 3, "min_fraction": 0.5}, "cluster_quality_weighting": {"enabled": True, "kappa_cluster": 1.0, "cap_enabled": False, "cap_ratio": 20.0}},
    "synthetic": {"weighting": "global", "frames_min": 5, "frames_max": 30},
    "bge": {"enabled": False, "method": "rbf", "grid": {"N_g": 32, "G_min_px": 64, "G_max_fraction": 0.25}},
}

# path, rule as (kind, value): one of some words, at least, above, a share, or a pair in order
RULES: tuple[tuple[str, str, object], ...] = (
    ("pipeline.mode", "one of", ("production", "test")),
    ("data.image_width", "at least", 0),
    ("data.image_height", "at least", 0),
    ("data.color_mode", "one of", ("OSC", "MONO", "RGB")),
    ("linearity.max_frames", "at least", 1),
    ("linearity.min_overall_linearity", "share", None),
    ("linearity.strictness", "one of", ("strict", "moderate", "permissive")),
    ("assumptions.pipeline_profile", "one of", ("practical", "strict")),
    ("assumptions.frames_min", "at least", 1),
    ("assumptions.frames_optimal", "at least", 1),
    ("assumptions.exposure_time_tolerance_percent", "at least", 0),
    ("assumptions.reduced_mode_cluster_range", "pair from", 1),
    ("normalization.enabled", "one of", (True,)),
    ("normalization.mode", "one of", ("background", "median")),
    ("registration.star_topk", "at least", 1),
    ("tile.size_factor", "above", 0),
    ("tile.min_size", "at least", 1),
    ("tile.max_divisor", "at least", 1),
    ("stacking.method", "one of", ("rej", "average")),
    ("stacking.sigma_clip.min_fraction", "share", None),
    ("stacking.cluster_quality_weighting.kappa_cluster", "above", 0),
    ("stacking.cluster_quality_weighting.cap_ratio", "above", 0),
    ("bge.grid.N_g", "at least", 1),
)


class Invalid(ValueError):
    """Settings that break a rule; the message names each of them."""


def merged(base: dict, over: dict, at: str = "") -> dict:
    """``over`` upon ``base``; names that the defaults do not know are refused."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        path = f"{at}{k}"
        if k not in base:
            raise Invalid(f"{path} is not known")
        if isinstance(base[k], dict):
            if not isinstance(v, dict):
                raise Invalid(f"{path} must hold settings")
            out[k] = merged(base[k], v, path + ".")
        else:
            out[k] = v
    return out


def get(config: dict, path: str) -> object:
    for k in path.split("."):
        config = config[k]
    return config


def _holds(value: object, kind: str, limit: object) -> bool:
    try:
        if kind == "one of":
            return value in limit
        if kind == "pair from":
            return len(value) == 2 and limit <= value[0] <= value[1]
        return {"at least": lambda: value >= limit, "above": lambda: value > limit, "share": lambda: 0 <= value <= 1}[kind]()
    except TypeError:
        return False


def validate(config: dict) -> dict:
    """``config``, if it keeps every rule."""
    bad = [f"{path} must be {kind}{'' if limit is None else f' {limit}'}, not {get(config, path)!r}" for path, kind, limit in RULES if not _holds(get(config, path), kind, limit)]
    a = config["assumptions"]
    if not bad and a["frames_reduced_threshold"] < a["frames_min"]:
        bad.append("assumptions.frames_reduced_threshold must be at least assumptions.frames_min")
    if config["data"]["linear_required"] and config["data"]["color_mode"] == "RGB":
        bad.append("data.linear_required must be false for RGB data")
    if bad:
        raise Invalid("; ".join(bad))
    return config


def loads(text: str) -> dict:
    """Settings of a YAML (or, without a YAML library, JSON) text upon the defaults."""
    try:
        import yaml
    except ImportError:
        found = json.loads(text or "{}")
    else:
        found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise Invalid("settings must be a mapping")
    return validate(merged(DEFAULTS, found or {}))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def save(config: dict, path: str) -> None:
    """JSON, which YAML readers take as well."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(validate(config), f, indent=2)


def schema() -> dict:
    """A JSON schema of the settings: kinds, defaults and allowed words."""
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array"}
    words = {path: list(limit) for path, kind, limit in RULES if kind == "one of"}

    def of(x: object, path: str) -> dict:
        if isinstance(x, dict):
            return {"type": "object", "additionalProperties": False, "properties": {k: of(v, f"{path}.{k}".lstrip(".")) for k, v in x.items()}}
        return {"type": kinds[type(x)], "default": x} | ({"enum": words[path]} if path in words else {})

    return of(DEFAULTS, "")
