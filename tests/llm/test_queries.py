from __future__ import annotations

import pytest

from palimpsest.llm import queries as q

from ..compare import connect, same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, sf, name):
    same(q.QUERIES[name](spark, sf), connect(sf), q.SQL[name])
