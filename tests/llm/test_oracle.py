"""Registered queries against their SQL on the smallest tables, and what else each contract says of a result."""

from pathlib import Path

import duckdb
import pytest

from tests.llm import brute
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name,key,source", [("op1_mixing", "doc_id", "documents"), ("op3_html_layout", "page_id", "pages"), ("op6_language_fusion", "page_id", "pages"), ("op8_tiff", "doc_id", "documents"), ("op9_license_rules", "doc_id", "documents"), ("op10_toxicity", "doc_id", "documents")])
def test_one_row_for_each_row(spark, con, name, key, source):
    got = sorted(r[key] for r in QUERIES[name](spark, str(DATA)).select(key).collect())
    assert got == [r[0] for r in con.execute(f"SELECT {key} FROM {source} ORDER BY 1").fetchall()]


def test_secrets_of_the_table(spark, con):
    want = {i: brute.secrets(t) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in QUERIES["op2_secret_ledger"](spark, str(DATA)).collect():
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in want[r.doc_id]) for k in ("assign", "access", "hex")]
