import json

import pytest

from riskmill.operators.models import LinearScorer
from riskmill.operators.scoring import responses, score_table
from riskmill.operators.validate import form_records, split_valid, validate_records, validate_rows
from riskmill.spec import SCREENING_SPEC, FeatureSpec

GOOD = {
    "age": 55, "gender": "Male", "hypertension": 1, "heart_disease": 0, "ever_married": "Yes",
    "work_type": "Private", "Residence_type": "Urban", "smoking_status": "formerly smoked",
}
SCORER = LinearScorer(
    -3.0, {"age": (43.0, 22.0, 1.5)},
    {c: {v: 0.1 * i for i, v in enumerate(d)} for c, d in SCREENING_SPEC.domains.items()},
    {"hypertension": 0.4, "heart_disease": 0.5},
)
GENDERS = "['Female', 'Male', 'Other']"


def without(field):
    return {k: v for k, v in GOOD.items() if k != field}


CASES = [
    (GOOD, []),
    ({**GOOD, "extra": {"a": 1}}, []),
    (without("smoking_status"), ["Missing required field: 'smoking_status'"]),
    ({**without("age"), "gender": "Unknown123"}, ["Missing required field: 'age'"]),
    ({**GOOD, "age": None}, ["Missing required field: 'age'"]),
    ({**GOOD, "age": ""}, ["Missing required field: 'age'"]),
    ({}, [f"Missing required field: '{c}'" for c in SCREENING_SPEC.features]),
    ({**GOOD, "age": -5}, ["Invalid age: -5. Must be between 0 and 120."]),
    ({**GOOD, "age": -1}, ["Invalid age: -1. Must be between 0 and 120."]),
    ({**GOOD, "age": 121}, ["Invalid age: 121. Must be between 0 and 120."]),
    ({**GOOD, "age": 150.0}, ["Invalid age: 150.0. Must be between 0 and 120."]),
    ({**GOOD, "age": 0}, []),
    ({**GOOD, "age": 120}, []),
    ({**GOOD, "age": "55"}, []),
    ({**GOOD, "age": " 55.5\t"}, []),
    ({**GOOD, "age": True}, []),
    ({**GOOD, "age": "old"}, ["Invalid age: old. Must be a number."]),
    ({**GOOD, "age": "55d"}, ["Invalid age: 55d. Must be a number."]),
    ({**GOOD, "age": "5_5"}, ["Invalid age: 5_5. Must be a number."]),
    ({**GOOD, "age": "nan"}, ["Invalid age: nan. Must be a number."]),
    ({**GOOD, "age": "-inf"}, ["Invalid age: -inf. Must be between 0 and 120."]),
    ({**GOOD, "age": [55]}, ["Invalid age: [55]. Must be a number."]),
    ({**GOOD, "gender": "Unknown123"}, [f"Invalid gender: 'Unknown123'. Must be one of: {GENDERS}"]),
    ({**GOOD, "gender": 1}, [f"Invalid gender: '1'. Must be one of: {GENDERS}"]),
    ({**GOOD, "smoking_status": "Unknown"}, []),
    ({**GOOD, "hypertension": 5}, ["Invalid hypertension: 5. Must be 0 or 1."]),
    ({**GOOD, "heart_disease": "yes"}, ["Invalid heart_disease: yes. Must be 0 or 1."]),
    ({**GOOD, "hypertension": 1.9}, []),
    ({**GOOD, "hypertension": "1.9"}, ["Invalid hypertension: 1.9. Must be 0 or 1."]),
    ({**GOOD, "hypertension": " 1 "}, []),
    ({**GOOD, "hypertension": False}, []),
    ({**GOOD, "hypertension": 1e300}, ["Invalid hypertension: 1.0E300. Must be 0 or 1."]),
    (
        {**GOOD, "smoking_status": "vapes", "work_type": "Freelancer", "hypertension": 2, "age": 150},
        [
            "Invalid age: 150. Must be between 0 and 120.",
            "Invalid hypertension: 2. Must be 0 or 1.",
            "Invalid work_type: 'Freelancer'. Must be one of: "
            "['Govt_job', 'Never_worked', 'Private', 'Self-employed', 'children']",
            "Invalid smoking_status: 'vapes'. Must be one of: ['Unknown', 'formerly smoked', 'never smoked', 'smokes']",
        ],
    ),
]
SHAPES = [
    ("{not valid json", ["Request body must be valid JSON."]),
    ("", ["Request body must be valid JSON."]),
    ("null", ["Request body must be valid JSON."]),
    ("[1, 2]", ["Request body must be a JSON object."]),
    ('"text"', ["Request body must be a JSON object."]),
    ("3", ["Request body must be a JSON object."]),
    (None, ["Request body must be valid JSON."]),
]


@pytest.fixture(scope="module")
def checked(spark):
    texts = [(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)]
    texts += [(len(CASES) + i, t) for i, (t, _) in enumerate(SHAPES)]
    return validate_records(spark.createDataFrame(texts, "id int, body string"), SCREENING_SPEC).cache()


def test_messages(checked):
    got = {r["id"]: r["errors"] for r in checked.collect()}
    for i, (case, want) in enumerate(CASES + SHAPES):
        assert got[i] == want, case


def test_scores_of_good_and_bad_records(checked):
    rows = {r["id"]: r for r in score_table(checked, SCREENING_SPEC, SCORER).collect()}
    assert rows[0]["valid"] and 0 <= rows[0]["risk_score"] <= 1 and rows[0]["threshold_used"] == 0.5
    assert rows[0]["risk_category"] in ("LOW", "MODERATE", "HIGH") and rows[0]["prediction"] in (0, 1)
    assert rows[0]["risk_score"] == rows[1]["risk_score"]
    assert rows[11]["risk_score"] < rows[12]["risk_score"]
    bad = rows[2]
    assert not bad["valid"]
    assert [bad[c] for c in ("risk_score", "prediction", "risk_category", "threshold_used")] == [None] * 4


def test_responses(checked):
    rows = {r["id"]: json.loads(r["response"]) for r in responses(score_table(checked, SCREENING_SPEC, SCORER)).collect()}
    good, bad = rows[0], rows[len(CASES) - 1]
    assert good["success"] and good["disclaimer"]
    assert good["data"]["risk_percentage"] == pytest.approx(good["data"]["risk_score"] * 100)
    assert good["data"]["predicted_class"] == ("Higher risk" if good["data"]["prediction"] else "Lower risk")
    assert bad == {
        "success": False,
        "error": {"code": "VALIDATION_ERROR", "message": "Invalid age: 150. Must be between 0 and 120."},
    }


def test_nothing_is_lost_in_quarantine(checked):
    good, rejected = split_valid(checked)
    assert good.count() == sum(not want for _, want in CASES)
    assert good.count() + rejected.count() == len(CASES) + len(SHAPES)


def test_validation_is_one_narrow_stage(checked, spark):
    df = validate_records(spark.createDataFrame([("{}",)], "body string"), SCREENING_SPEC)
    plan = score_table(df, SCREENING_SPEC, SCORER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_typed_rows_follow_the_same_rules(spark):
    schema = (
        "age double, gender string, hypertension int, heart_disease int, ever_married string, work_type string, "
        "Residence_type string, smoking_status string"
    )
    good = [GOOD[c] for c in SCREENING_SPEC.features]
    rows = [(float(good[0]), *good[1:]), (float("nan"), *good[1:]), (None, *good[1:]), (55.0, "x", 7, *good[3:])]
    got = [r["errors"] for r in validate_rows(spark.createDataFrame(rows, schema), SCREENING_SPEC).collect()]
    assert got == [
        [], ["Invalid age: NaN. Must be a number."], ["Missing required field: 'age'"],
        ["Invalid hypertension: 7. Must be 0 or 1.", f"Invalid gender: 'x'. Must be one of: {GENDERS}"],
    ]


def test_a_form_sends_trimmed_numbers(spark):
    rows = [(1, " 55 ", "Private\t", "1"), (2, "\t", "a \"b\"", " 0\n"), (3, "1e2", None, ""), (4, "ten", "x", "yes"),
            (5, "NaN", " ", "2"), (6, None, "y", None)]
    spec = FeatureSpec(key="k", numeric=("n",), categorical=("c",), binary=("f",), target="t")
    sent = form_records(spark.createDataFrame(rows, "k int, n string, c string, f string"), spec)
    got = {r["k"]: json.loads(r["body"]) for r in sent.collect()}
    assert got == {
        1: {"n": 55.0, "c": "Private\t", "f": 1}, 2: {"c": 'a "b"', "f": 0}, 3: {"n": 100.0}, 4: {"n": "ten", "c": "x", "f": "yes"},
        5: {"n": "NaN", "f": 2}, 6: {"c": "y"},
    }
