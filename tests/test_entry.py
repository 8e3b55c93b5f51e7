"""Every registered query equals its SQL on the smallest tables, where these are there."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(frame):
    def text(v):
        if v is None or v != v:
            return "null"
        # pandas makes whole numbers floats where a column has nulls.
        return v.isoformat() if hasattr(v, "isoformat") else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    return sorted(tuple(text(r[c]) for c in sorted(frame.columns)) for r in frame.to_dict("records"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert plain(QUERIES[name](spark, str(DATA)).toPandas()) == plain(db.execute(ORACLES[name]).fetchdf())


def test_entry_without_the_corpus_operators(tmp_path):
    """A library that they need and that isn't there leaves all other queries."""
    root = Path(__spark_entry__.__file__).parent
    code = "import sys; sys.modules['tidemark.llm.queries'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') and k[2].isdigit() for k in e.queries()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), "0"]


def test_entry_names():
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
