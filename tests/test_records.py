"""Record validation against a plain strict reader."""

import copy
import json
import math

import pytest

from textaxis.operators import records as R

GOOD = {"example_id": "e1", "prompt_text": "p", "quadrant_scores": dict.fromkeys(R.QUADRANTS, 0.5), "bias_magnitude": 1, "target_policy": dict.fromkeys(R.QUADRANTS, 0.25), "hidden_representation_ref": "h.pt:3", "metadata": {"a": 1}}


def changed(**k):
    out = copy.deepcopy(GOOD)
    for path, v in k.items():
        at, *rest = path.split("__")
        if rest:
            out[at][rest[0]] = v
        elif v is ...:
            del out[at]
        else:
            out[at] = v
    return out


CASES = {
    "fine": (GOOD, []), "no metadata": (changed(metadata=...), []), "list": ([1], ["not_an_object"]), "number": (5, ["not_an_object"]),
    "no policy": (changed(target_policy=...), ["target_policy:missing"]), "null policy": (changed(target_policy=None), ["target_policy:not_an_object"]),
    "id number": (changed(example_id=5), ["example_id:not_a_string"]), "id blank": (changed(example_id=" \t"), ["example_id:empty"]), "prompt null": (changed(prompt_text=None), ["prompt_text:not_a_string"]),
    "bias bool": (changed(bias_magnitude=True), ["bias_magnitude:not_a_number"]), "bias text": (changed(bias_magnitude="1"), ["bias_magnitude:not_a_number"]), "bias float": (changed(bias_magnitude=1.5e300), []),
    "score bool": (changed(quadrant_scores__left_lib=False), ["quadrant_scores:not_numbers"]), "score negative": (changed(quadrant_scores__left_lib=-7), []),
    "score more": (changed(quadrant_scores__other=1), ["quadrant_scores:unexpected_keys"]), "score empty": (changed(quadrant_scores={}), ["quadrant_scores:missing_keys"]),
    "policy zero": (changed(target_policy__left_lib=0, target_policy__left_auth=0.5), ["target_policy:not_positive"]), "policy sum": (changed(target_policy__left_lib=0.3), ["target_policy:sum"]),
    "policy near": (changed(target_policy__left_lib=0.2500005), []), "ref bare": (changed(hidden_representation_ref="h.pt"), ["hidden_representation_ref:no_colon"]), "ref empty": (changed(hidden_representation_ref=""), ["hidden_representation_ref:not_a_string"]),
    "ref nameless": (changed(hidden_representation_ref=":3"), ["hidden_representation_ref:no_file", ]), "ref odd": (changed(hidden_representation_ref="h.pt:x"), ["hidden_representation_ref:no_row"]),
    "ref negative": (changed(hidden_representation_ref="h.pt:-1"), ["hidden_representation_ref:negative"]), "ref far": (changed(hidden_representation_ref="h.pt:10"), ["hidden_representation_ref:out_of_range"]),
    "ref other": (changed(hidden_representation_ref="a:b:1"), ["hidden_representation_ref:other_file"]), "metadata": (changed(metadata=[1]), ["metadata:not_an_object"]),
    "many": (changed(bias_magnitude=None, prompt_text=" ", target_policy__left_lib=-0.25), ["prompt_text:empty", "bias_magnitude:not_a_number", "target_policy:not_positive", "target_policy:sum"]),
    "broken": ("{broken", ["invalid_json"]), "nan": ('{"example_id": NaN}', ["invalid_json"]),
}


def test_every_reason(spark):
    rows = []
    for i, (name, (record, _)) in enumerate(CASES.items()):
        if isinstance(record, dict) and isinstance(record.get("example_id"), str) and record["example_id"].strip():
            record = record | {"example_id": name}
        rows.append((i, record if isinstance(record, str) else json.dumps(record)))
    again = [(1000, json.dumps(GOOD | {"example_id": "fine"})), (1001, json.dumps(GOOD | {"example_id": "fine", "bias_magnitude": []})), (2000, "  "), (2001, None)]
    got = {r.at: r for r in R.validate_records(spark.createDataFrame(rows + again, "at long, line string").repartition(4), "line", "at", "h.pt", 10).collect()}
    names = R.rule_names("h.pt", 10)
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i].reasons == want, name
        assert [n for b, n in enumerate(names) if got[i].failed >> b & 1] == want and got[i].first_reason == (want[0] if want else None)
    assert got[1000].reasons == ["repeated_id"] and got[1001].reasons == ["bias_magnitude:not_a_number", "repeated_id"] and 2000 not in got and 2001 not in got


def test_strict_reading_stops_at_the_first(spark):
    lines = lambda *x: R.validate_records(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(x)], "at long, line string"), "line", "at")
    second = GOOD | {"example_id": "e2"}
    R.require_valid(lines(GOOD, second), "at", 2, 4, 4)
    for report, rows, message in ((lines(GOOD, changed(prompt_text=1), changed(example_id=1)), None, r"\[e1\] prompt_text:not_a_string \(at 1\)"), (lines(GOOD, second), 1, "2 records for 1 rows"), (lines(GOOD).where("false"), None, "no records")):
        with pytest.raises(R.RecordError, match=message):
            R.require_valid(report, "at", rows)
    with pytest.raises(R.RecordError, match="3 wide"):
        R.require_valid(lines(GOOD), "at", width=3, expected_width=4)
    assert math.isclose(R.SUM_TOLERANCE, 1e-6)
