"""Every query against its SQL twin in DuckDB."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest

from pagemill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return repr(round(float(v), 6) + 0.0) if hasattr(v, "__float__") else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if sql := catalog.ORACLES.get(name):
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_every_html_block_is_classified(spark, sf, duck):
    """One row a block of whole pages, counted without the adapter."""
    got = catalog.QUERIES["q60_html_block_classes"](spark, sf).toPandas()
    pages = duck.sql("select html from pages").df()["html"]
    want = sum(len(re.findall(rf"(?s)<{tag}>.*?</{tag}>", html)) for html in pages for tag in ("title", "h1", "p", "li", "nav", "footer"))
    assert len(got) == want > 5 * len(pages)
    assert {"heading", "header", "footer", "footnote", "paragraph"} <= set(got.block_type)


def alike(spark, name, folder):
    """The query and its SQL twin give the same rows of the tables in a folder."""
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    assert rows(catalog.QUERIES[name](spark, folder).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_classes_of_lines_at_a_limit(spark, tmp_path):
    """Line 80 ends at 0.8 + 0.02 of its page, just above 0.82."""
    text = "\n".join(f"some line {i}" for i in range(200))
    pd.DataFrame({"doc_id": [2, 487], "text": [text] * 2, "lang": "en", "source": "s", "n_chars": len(text)}).to_parquet(tmp_path / "documents.parquet")
    alike(spark, "q06_block_classes", str(tmp_path))


def test_edges_rounded_at_a_half(spark):
    """137.4 / 40 is 3.435, whose hundredfold is no half in binary."""
    alike(spark, "q64_matched_fragments", "/root/testdata/sf0.1")
