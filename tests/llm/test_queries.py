"""The corpus queries on the smallest tables: against SQL where there is some, else that they run and keep every row."""

from pathlib import Path

import duckdb
import pytest

from tests.test_entry import plain
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLES:
        db = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert plain(found) == plain(db.execute(ORACLES[name]).fetchdf())
    elif name != "op9_packing":
        assert len(found) == (500 if name.startswith("op3") else 200)
    else:
        assert found["doc_id"].nunique() == 200
