import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.operators.packed_values import explode_packed, split_packed


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []),
        ("", []),
        ("  \n ", []),
        ("Doe, Ann", ["Doe, Ann"]),
        ("Ann Doe", ["Ann Doe"]),
        ("Doe A, Roe B", ["Doe A", "Roe B"]),
        ("A. Doe, B. C. Roe, and D. Poe", ["A. Doe", "B. C. Roe", "D. Poe"]),
        ("Doe, A. B., & Roe, C.", ["Doe, A. B.", "Roe, C."]),
        ("Doe, Ann and Roe, Bob", ["Doe, Ann", "Roe, Bob"]),
        ('"Doe, Ann"; "Roe, Bob"', ["Doe, Ann", "Roe, Bob"]),
        ("“Doe, Ann”,“Bay and River Survey Team”", ["Doe, Ann", "Bay and River Survey Team"]),
        ('"Ann ""Nan"" Doe";Bob Roe', ['Ann "Nan" Doe', "Bob Roe"]),
        ("Ann Doe; ; Bob Roe;", ["Ann Doe", "Bob Roe"]),
        ("Doe A; Roe B; et al.", ["Doe A", "Roe B"]),
        ("Ann Doe et al.", ["Ann Doe"]),
        ("Ann Doe; Open Layout and Archive Consortium", ["Ann Doe", "Open Layout and Archive Consortium"]),
        ("A. Doe and B. Roe; C. Poe", ["A. Doe", "B. Roe", "C. Poe"]),
        ("Ann Doe | Bob Roe / Cy Poe · Di Loe", ["Ann Doe", "Bob Roe", "Cy Poe", "Di Loe"]),
        ("Doe, A.\nRoe, B.", ["Doe, A.", "Roe, B."]),
        ("Ann (x; y) Doe; Bob Roe", ["Ann (x; y) Doe", "Bob Roe"]),
        ('"Doe, Ann', ["Doe, Ann"]),
    ],
)
def test_split(text, values):
    assert split_packed(text) == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcXYZ ;,|&\"'", min_size=1, max_size=12).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoted_values_round_trip(values):
    packed = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_packed(packed) == [v.strip() for v in values]


def test_rows(spark):
    rows = [("n1", "Doe, Ann; Roe, Bob", None, 1), ("n1", "Doe, Ann; Roe, Bob", None, 2), (None, "X Y", "Z W", 3), ("n2", "", "A. Doe, B. Roe", 4)]
    df = spark.createDataFrame(rows, "node_id string, a string, b string, val int")
    got = {tuple(r) for r in explode_packed(df, "node_id", ["a", "b"]).collect()}
    assert got == {("n1", "a", 1, "Doe, Ann"), ("n1", "a", 2, "Roe, Bob"), ("n2", "b", 1, "A. Doe"), ("n2", "b", 2, "B. Roe")}
    assert explode_packed(df.limit(0), "node_id", ["a"]).count() == 0
