"""Every query with an oracle gives the oracle's rows; the others are in test_brute.py."""

from pathlib import Path

import oracle
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_every_other_query_is_tested_against_brute_force():
    brute = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py") if p.name != "test_oracles.py")
    assert all(name in brute for name in set(QUERIES) - set(ORACLES))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def larger():
    return oracle.connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_has_rows(larger, name):
    """Where nothing comes out, agreement proves nothing."""
    assert larger.sql(f"SELECT 1 FROM ({ORACLES[name]}) LIMIT 1").fetchall()
