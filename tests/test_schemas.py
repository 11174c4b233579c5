"""Nested schemas as columns: paths of what is wrong, nulls, and the JSON types of parsed answers."""

import json

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import schemas as C
from tenderloom.operators import matching as M
from tenderloom.operators import tables as K
from tenderloom.plans import queries as P

SHAPE = C.record(
    name=C.text(1, 5), kind=C.one_of("a", "b").or_null(), size=C.whole(0, 9), share=C.number(0, 1).optional(), on=C.flag.optional(),
    tags=C.list_of(C.text(2), 1, 3).optional(), parts=C.list_of(C.record(id=C.whole(1), inner=C.list_of(C.list_of(C.text(1))).optional())).optional(),
)


def parsed(spark, *docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", C.once(F.parse_json("j")).alias("v"))
    failed = C.problems(lambda n: C.Parsed(F.try_variant_get("v", f"$.{n}", "variant")), SHAPE)
    return [r.failed for r in df.withColumn("failed", failed).orderBy("i").collect()]


GOOD = {"name": "n", "kind": "a", "size": 3}


@pytest.mark.parametrize("part, failed", [
    ({}, []), ({"kind": None}, []), ({"size": 3.0}, []), ({"share": 0}, []), ({"more": [1]}, []), ({"tags": ["ab"]}, []), ({"parts": []}, []),
    ({"name": ""}, ["name"]), ({"name": "sixsix"}, ["name"]), ({"name": None}, ["name"]), ({"name": 5}, ["name"]), ({"kind": "c"}, ["kind"]), ({"size": -1}, ["size"]), ({"size": 10}, ["size"]), ({"size": 2.5}, ["size"]), ({"size": "3"}, ["size"]), ({"size": True}, ["size"]),
    ({"share": 1.01}, ["share"]), ({"share": None}, ["share"]), ({"on": "yes"}, ["on"]), ({"on": None}, ["on"]), ({"tags": []}, ["tags"]), ({"tags": ["ab"] * 4}, ["tags"]), ({"tags": ["ab", "a", None, 3]}, ["tags", "tags[1]", "tags[2]", "tags[3]"]), ({"tags": "ab"}, ["tags"]), ({"tags": {"a": 1}}, ["tags"]),
    ({"parts": [{"id": 1}, {"id": 0}, {}, 4, {"id": 2, "inner": [["x"], ["", "y"], []]}]}, ["parts[1].id", "parts[2].id", "parts[3]", "parts[4].inner[1][0]"]), ({"name": "", "size": "x"}, ["name", "size"]),
])
def test_paths_of_parsed_json(spark, part, failed):
    assert parsed(spark, GOOD | part) == [failed]


def test_left_out_is_not_null(spark):
    assert parsed(spark, {"name": "n", "size": 1}, {"size": 1, "kind": None}) == [["kind"], ["name"]]


def test_typed_columns(spark):
    rows = spark.createDataFrame([("n", "a", 3, None, ["ab", "c", None]), (None, None, None, 2.0, None), ("n", "x", 10, float("nan"), [])], "name string, kind string, size int, share double, tags array<string>")
    some = C.record(**{n: f for n, f in SHAPE.fields if n in rows.columns})
    got = [r.f for r in rows.select(C.problems(lambda n: C.Typed(F.col(n)), some, {"size": F.col("size") < 10}).alias("f")).collect()]
    assert got == [["tags[1]", "tags[2]"], ["name", "size", "share"], ["kind", "size", "share", "tags"]]


def test_a_row_of_nulls_is_no_schedule(spark):
    row = spark.createDataFrame([(None,) * 7], "frequency string, interval_days int, hour_local int, hour_local_end int, day_of_week int, day_of_month int, recipients array<string>")
    assert K.validate_schedules(row)[1].first().failed == ["frequency", "hour_local", "hour_local_end"]
    fine = spark.createDataFrame([("weekly", None, 8, 8, 0, None, ["a.b+c@d-e.org"])], row.schema)
    assert K.validate_schedules(fine)[0].count() == 1


def test_every_rule_of_an_answer(spark):
    """Each wrong answer of the query names just the path that was changed; the fine ones come out whole."""
    df = spark.createDataFrame([(i, x.replace('"#fit"', "50").replace('"#people"', "3").replace('"#count"', "2")) for i, (x, _) in enumerate(P._ANSWERS)], "i int, answer string")
    valid, rejects = M.parse_assessment(df, "answer")
    assert {r.i: ",".join(r.failed) for r in rejects.collect()} == {i: f for i, (_, f) in enumerate(P._ANSWERS) if f}
    first = valid.orderBy("i").first().assessment.asDict(True)
    assert first["fit_score"] == 50 and first["win_probability_reason"] == "near" and first["collaboration_suggestion"]["geography_hint"] == "DE"
    assert first["human_resources_estimate"]["roles"][1] == {"role": "engineer", "count": 2, "seniority": "senior", "rationale": "r"}
    assert [r.assessment.gaps for r in valid.orderBy("i").collect()][1] == []
    assert M.parse_assessment(spark.createDataFrame([(0, None)], df.schema), "answer")[1].first().failed == ["json"]
