"""Typed configuration: a schema as data, checked whole, with every error at once.

A schema is a tree of ``Field`` and nested dicts. A field has a kind, a range, choices and a default; rules over several
fields are functions of the parsed tree. ``load`` reads YAML or JSON from any store that Spark reads.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

_NEEDED = object()


class ConfigError(ValueError):
    """All that is wrong with a configuration, one line for each."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Field:
    """One value. ``kind``: string, path, bool, int, number, strings, ints or numbers (lists). Bounds are ``low <= v <= high``, strict with
    ``above`` and ``below``; ``choices`` hold for each item of a list. Without ``default`` it must be there; ``optional`` allows null."""

    kind: str
    low: float | None = None
    high: float | None = None
    above: float | None = None
    below: float | None = None
    not_value: float | None = None
    choices: tuple = ()
    holds: tuple = ()
    distinct: bool = False
    empty: bool = False
    optional: bool = False
    default: Any = _NEEDED


def _is(kind: str, v: Any) -> bool:
    if kind in ("int", "number"):
        return not isinstance(v, bool) and isinstance(v, int if kind == "int" else (int, float))
    return isinstance(v, bool) if kind == "bool" else isinstance(v, str) and bool(v.strip())


_SAYS = {"string": "a string that isn't empty", "path": "a path", "bool": "true or false", "int": "a whole number", "number": "a number"}


def _value_errors(f: Field, at: str, v: Any) -> list[str]:
    one = {"strings": "string", "ints": "int", "numbers": "number"}.get(f.kind)
    if one is not None:
        if not isinstance(v, list) or not v and not f.empty:
            return [f"{at} must be a list{'' if f.empty else ' with an item'}, not {v!r}"]
        out = [f"{at}[{i}] must be {_SAYS[one]}, not {x!r}" for i, x in enumerate(v) if not _is(one, x)]
        if out:
            return out
        out = [f"{at}[{i}] must be one of {', '.join(map(str, f.choices))}, not {x!r}" for i, x in enumerate(v) if f.choices and x not in f.choices]
        out += [f"{at} must hold {x!r}" for x in f.holds if x not in v]
        return out + ([f"{at} holds an item twice"] if f.distinct and len(set(v)) < len(v) else [])
    if not _is(f.kind, v):
        return [f"{at} must be {_SAYS[f.kind]}, not {v!r}"]
    if f.choices and v not in f.choices:
        return [f"{at} must be one of {', '.join(map(str, f.choices))}, not {v!r}"]
    if f.kind in ("int", "number"):
        if not math.isfinite(v):
            return [f"{at} must be finite"]
        wrong = [(f.low is not None and v < f.low, f"at least {f.low}"), (f.high is not None and v > f.high, f"at most {f.high}"), (f.above is not None and v <= f.above, f"over {f.above}"),
                 (f.below is not None and v >= f.below, f"under {f.below}"), (f.not_value is not None and v == f.not_value, f"other than {f.not_value}")]
        return [f"{at} must be {says}, not {v}" for bad, says in wrong if bad]
    return []


def _checked(schema: dict, raw: Any, at: str, root: str | None, errors: list[str]) -> dict:
    if not isinstance(raw, dict):
        errors.append(f"{at} must be a mapping, not {raw!r}")
        return {}
    out: dict[str, Any] = {}
    for name, f in schema.items():
        where = f"{at}.{name}"
        if isinstance(f, dict):
            if name in raw:
                out[name] = _checked(f, raw[name], where, root, errors)
            else:
                errors.append(f"{where} is missing")
        elif name not in raw:
            if f.default is _NEEDED:
                errors.append(f"{where} is missing")
            else:
                out[name] = f.default
        elif raw[name] is None and f.optional:
            out[name] = None
        elif found := _value_errors(f, where, raw[name]):
            errors += found
        else:
            v = raw[name]
            out[name] = float(v) if f.kind == "number" else [float(x) for x in v] if f.kind == "numbers" else v
            if f.kind == "path" and root is not None and not v.startswith("/") and "://" not in v:
                out[name] = f"{root.rstrip('/')}/{v}"
    return out


def validate(raw: Any, schema: dict, name: str = "config", root: str | None = None, rules: tuple[Callable[[dict], str | None], ...] = ()) -> dict:
    """The parsed tree: defaults filled in, numbers as floats, relative paths under ``root``, keys that the schema doesn't name left
    out. Raises ``ConfigError`` with all errors.

    ``rules`` get the tree and return what is wrong or None; a rule whose fields are missing or wrong is passed over.
    """
    errors: list[str] = []
    tree = _checked(schema, raw, name, root, errors)
    for rule in rules:
        try:
            said = rule(tree)
        except (KeyError, TypeError):
            continue
        errors += [f"{name}.{said}"] if said else []
    if errors:
        raise ConfigError(errors)
    return tree


def load(spark: SparkSession, path: str, schema: dict, section: str | None = None, root: str | None = None, rules: tuple[Callable[[dict], str | None], ...] = ()) -> dict:
    """``validate`` of a YAML or JSON file, or of one of its top sections. Where no YAML reader is installed, only JSON is read."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    if section is not None:
        if not isinstance(raw, dict) or section not in raw:
            raise ConfigError([f"{section} is missing"])
        raw = raw[section]
    return validate(raw, schema, section or "config", root, rules)


#: Fixed values of the calibration run's configuration.
_PATH, _SEED, _FLAG = Field("path"), Field("int"), Field("bool")
_SPLITS = ("val_indist", "val_source", "val_topic")
CALIBRATION = {
    "paths": {
        "prompt_sources": {"method12_path": _PATH, "method3_path": _PATH, "expert_validation_dir": _PATH},
        "steering_vectors": {"economic_vector_path": _PATH, "social_vector_path": _PATH},
        "expert_checkpoints": {f"{q}_checkpoint": _PATH for q in ("left_lib", "left_auth", "right_lib", "right_auth")},
        **{name: _PATH for name in ("output_dir", "prompts_path", "features_path", "hidden_path", "records_path", "candidate_traces_path", "splits_dir", "checkpoints_dir", "reports_dir")}},
    "model": {"base_model": Field("string"), "dtype": Field("string", choices=("bfloat16", "float16", "float32")), "device": Field("string")},
    "input_transformer": {
        "vector_method": Field("string", choices=("logistic_regression", "mean_difference")), "use_final_aggregated_vectors": _FLAG, "selected_layers": Field("ints", holds=(20,)),
        "pooling_method": Field("string", choices=("mean",)), "use_centering": _FLAG, "neutral_reference_path": Field("path", optional=True), "calibration_input_dim": Field("int", low=1)},
    "prompt_set": {
        "include_method12": _FLAG, "include_method3": _FLAG, "include_expert_validation": Field("bool", default=False), "expert_validation_splits": Field("strings", choices=_SPLITS, distinct=True, default=list(_SPLITS)),
        "max_prompts": Field("int", low=1, optional=True), "seed": _SEED},
    "candidate_policies": {
        "include_heuristic_prior": _FLAG, "include_uniform": _FLAG, "sharpen_temperatures": Field("numbers", empty=True), "soften_temperatures": Field("numbers", empty=True), "include_opposite_heavy": _FLAG, "include_adjacent_heavy": _FLAG,
        "dirichlet_samples": Field("int", low=1), "dirichlet_concentration": Field("number"), "min_probability": Field("number", above=0, below=0.25), "seed": _SEED},
    "generation": {"max_new_tokens": Field("int", low=1), "temperature": Field("number"), "do_sample": _FLAG, "top_p": Field("number")},
    "scoring": {
        "score_temperature": Field("number", above=0), "weights": {w: Field("number") for w in ("bias_radius", "quality", "refusal", "vagueness", "kl_to_prior")}, "normalize_bias_radius": _FLAG,
        "baseline_bias_radius_path": Field("path", optional=True), "judge": {"enabled": _FLAG, "provider": Field("string", optional=True), "model": Field("string", optional=True)}},
    "split": {**{f"{s}_fraction": Field("number", above=0) for s in ("train", "val", "test")}, "split_by": Field("string"), "seed": _SEED},
    "training": {
        "beta": Field("number"), "temperature": Field("number", not_value=0), "learning_rate": Field("number"), "weight_decay": Field("number"), "batch_size": Field("int", low=1), "epochs": Field("int", low=1), "kl_weight": Field("number"),
        "entropy_weight": Field("number"), "seed": _SEED, "device": Field("string")},
}


def fractions_sum_to_one(tree: dict) -> str | None:
    """The three parts of a split are all of it."""
    total = sum(tree["split"][f"{s}_fraction"] for s in ("train", "val", "test"))
    return None if abs(total - 1) <= 1e-6 else f"split: fractions must sum up to 1, not {round(total, 9)}"


def load_calibration(spark: SparkSession, path: str, root: str | None = None) -> dict:
    """The ``router_calibration`` section of a configuration file."""
    return load(spark, path, CALIBRATION, "router_calibration", root, (fractions_sum_to_one,))
