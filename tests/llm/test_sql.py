"""Each query that SQL can say against its SQL over the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from packetloom.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, want = q.QUERIES[name](spark, SF), con.sql(q.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
