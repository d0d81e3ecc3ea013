import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from topicweave.operators.packed import explode_packed, record_terms

CASES = [
    ("a; b;;c ", ["a", "b", "c"]),
    ('"a; b", c', ["a; b", "c"]),
    ('x|"the ""long"" shelf"', ["x", 'the "long" shelf']),
    ("['q w', 'e,r']", ["q w", "e,r"]),
    ("[single]", ["single"]),
    ("a, b; c", ["a, b", "c"]),
    ("a, b", ["a", "b"]),
    ("read/write x / y - z-w", ["read/write x", "y", "z-w"]),
    ('"one', ['"one']),
    ("A · B、C；D\tE<br>F\nG", ["A", "B", "C", "D", "E", "F", "G"]),
    ("", []),
    ("  ; ;", []),
    (None, []),
]
PERSONS = [
    ("Smith, J.", ["Smith, J."]),
    ("U. Klik, S. Dicic", ["U. Klik", "S. Dicic"]),
    ("A, B.; C, D. & E, F.", ["A, B.", "C, D.", "E, F."]),
    ('Mod, J. and "H, M."', ["Mod, J.", "H, M."]),
    ('"Lok, L. F."', ["Lok, L. F."]),
    ("Smith, J., Doe, K.", ["Smith, J.", "Doe, K."]),
    ("Institute for Reader Studies (Foo)", ["Institute for Reader Studies (Foo)"]),
]


@pytest.mark.parametrize("cases,persons", [(CASES, False), (PERSONS, True)])
def test_layouts(spark, cases, persons):
    df = spark.createDataFrame([(i, c, "x") for i, (c, _) in enumerate(cases)], "id long, v string, item string")
    got = {i: [] for i in range(len(cases))}
    for r in explode_packed(df, "id", "v", persons).orderBy("id", "pos").collect():
        assert r.pos == len(got[r.id])
        got[r.id].append(r.item)
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab ,;\"-", min_size=1).map(str.strip).filter(bool), min_size=1, max_size=4), min_size=1, max_size=6))
def test_quoted_values_come_back(spark, records):
    packed = [(i, ";".join('"' + v.replace('"', '""') + '"' for v in values)) for i, values in enumerate(records)]
    df = explode_packed(spark.createDataFrame(packed, "id long, v string"), "id", "v")
    got = {}
    for r in df.orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.item)
    assert [got[i] for i in range(len(records))] == records


def test_terms_long_and_null_key(spark):
    df = spark.createDataFrame([(None, "Open_Shelving;open-shelving"), (1, ";".join(f"w{i}" for i in range(5000)))], "id long, v string")
    got = {r.id: r.terms for r in record_terms(df, "id", "v").collect()}
    assert got[None] == ["open shelving"] * 2 and len(got[1]) == 5000


def test_empty_table(spark):
    assert explode_packed(spark.createDataFrame([], "id long, v string"), "id", "v").count() == 0
