"""Every SQL-expressible query equals its independent DuckDB statement (sf0.001)."""

import math

import pytest

from lanespark.plans import registry

registry.load_all()
from small_data import SF_SMALL  # noqa: E402

# slow ML / streaming keys are covered by dedicated tests
KEYS = sorted(k for k in registry.ORACLES if not k.startswith("stream_"))


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    sdf = registry.QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(registry.ORACLES[key])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _rows(srows, sdf.columns) == _rows(drows, rel.columns)
