import os

import pytest

from stateloom import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_states_of_the_balance_are_made_once(spark, monkeypatch):
    opened = []
    table = queries._table
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: opened.append(name) or table(spark, sf_dir, name))
    assert queries.forecast_balance(spark, DATA).count() == 1
    assert opened == ["lineitem"]
