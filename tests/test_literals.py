"""Literal cases whose results were worked out from the rules by hand."""

import pytest
from literal_cases import CASES
from literal_expected import EXPECTED
from test_queries import rows

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


def test_every_case_has_its_rows():
    assert set(CASES) == set(EXPECTED)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, want = EXPECTED[name]
    kinds = dict(c.replace('"', "").split(" ") for c in columns.split(", "))
    got = CASES[name](spark, "")
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == kinds
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(list(kinds), want)
