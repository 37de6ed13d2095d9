"""Configuration: one error for each fault, all at once."""

import copy
import json

import pytest

from textaxis.sources import config as C


def example(schema=C.CALIBRATION):
    values = {"path": "data/x", "string": "s", "bool": True, "int": 3, "number": 0.1, "strings": ["val_topic"], "ints": [3, 20], "numbers": [0.5]}
    return {k: example(f) if isinstance(f, dict) else f.choices[0] if f.choices and f.kind == "string" else values[f.kind] for k, f in schema.items()} | ({"split": {"train_fraction": 0.8, "val_fraction": 0.1, "test_fraction": 0.1, "split_by": "prompt", "seed": 1}} if schema is C.CALIBRATION else {})


def write(tmp_path, tree, text=None):
    (tmp_path / "c.yaml").write_text(text if text is not None else json.dumps({"router_calibration": tree, "other": 1}))
    return str(tmp_path / "c.yaml")


def test_a_whole_configuration(spark, tmp_path):
    tree = example()
    del tree["prompt_set"]["expert_validation_splits"], tree["prompt_set"]["include_expert_validation"]
    tree["input_transformer"]["neutral_reference_path"], tree["training"]["beta"] = None, 2
    tree["model"]["odd"] = 1
    tree["paths"]["output_dir"], tree["paths"]["hidden_path"] = "/abs/out", "s3://bucket/hidden"
    got = C.load_calibration(spark, write(tmp_path, tree), "/root/of/project/")
    assert got["prompt_set"]["expert_validation_splits"] == ["val_indist", "val_source", "val_topic"] and got["prompt_set"]["include_expert_validation"] is False
    assert "odd" not in got["model"] and got["training"]["beta"] == 2.0 and isinstance(got["training"]["beta"], float) and got["input_transformer"]["neutral_reference_path"] is None
    assert got["paths"]["splits_dir"] == "/root/of/project/data/x" and got["paths"]["output_dir"] == "/abs/out" and got["paths"]["hidden_path"] == "s3://bucket/hidden"


def test_all_errors_at_once(spark, tmp_path):
    tree = copy.deepcopy(example())
    tree["model"]["dtype"] = "int8"
    tree["training"] |= {"temperature": 0, "batch_size": True, "epochs": 0, "learning_rate": "fast"}
    tree["candidate_policies"]["min_probability"] = 0.25
    tree["scoring"]["score_temperature"], tree["scoring"]["weights"] = -1, [1]
    tree["input_transformer"]["selected_layers"] = [3]
    tree["prompt_set"] |= {"expert_validation_splits": ["val_topic", "val_topic"], "max_prompts": 0, "odd": 1}
    tree["split"]["train_fraction"] = 0.7
    del tree["paths"]["expert_checkpoints"]["left_auth_checkpoint"], tree["generation"]
    with pytest.raises(C.ConfigError) as e:
        C.load_calibration(spark, write(tmp_path, tree))
    said = {x.split(" ")[0].removeprefix("router_calibration.").rstrip(":") for x in e.value.errors}
    assert said == {
        "model.dtype", "training.temperature", "training.batch_size", "training.epochs", "training.learning_rate", "candidate_policies.min_probability", "scoring.score_temperature", "scoring.weights", "input_transformer.selected_layers",
        "prompt_set.expert_validation_splits", "prompt_set.max_prompts", "split", "paths.expert_checkpoints.left_auth_checkpoint", "generation"}
    assert len(e.value.errors) == 14 and any("sum up to 1, not 0.9" in x for x in e.value.errors)


def test_other_shapes(spark, tmp_path):
    with pytest.raises(C.ConfigError, match="router_calibration is missing"):
        C.load_calibration(spark, write(tmp_path, None, "[1]"))
    with pytest.raises(C.ConfigError, match="router_calibration must be a mapping"):
        C.load_calibration(spark, write(tmp_path, 5))
    schema = {"a": C.Field("ints", empty=True), "b": C.Field("number", low=0, high=1), "c": C.Field("strings", default=[])}
    assert C.validate({"a": [], "b": 1}, schema) == {"a": [], "b": 1.0, "c": []}
    for raw, words in (({"a": [1, True], "b": 2}, r"a\[1\] must be a whole number, not True\nconfig.b must be at most 1"), ({"a": None, "b": float("nan")}, "a must be a list, not None\nconfig.b must be finite")):
        with pytest.raises(C.ConfigError, match=words):
            C.validate(raw, schema)
