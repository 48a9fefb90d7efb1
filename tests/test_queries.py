import re

import pytest

from conftest import SF, rows
from pagemill.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_whole_texts(spark):
    """Nothing of a text is left out: all its letters are encoded, and all its words can be zipped."""
    from pagemill.queries import LETTERS

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n"], r["codes"]) for r in QUERIES["ctc_encode_targets"](spark, SF).collect()}
    codes = {i: [str(LETTERS.index(c)) for c in t if c in LETTERS] for i, t in texts.items()}
    assert got == {i: (len(c), ",".join(c)) for i, c in codes.items()}
    n = {r["doc_id"]: r["count"] for r in QUERIES["zip_truncate"](spark, SF).groupBy("doc_id").count().collect()}
    words = {i: len(re.split("[ \n]+", t)) for i, t in texts.items()}
    assert n == {i: min(words[i], i * 37 % 700 + 1) for i in texts}
    assert {words[i] < i * 37 % 700 + 1 for i in texts} == {True, False}


def test_ceil32_scale_of_odd_lengths(spark, tmp_path):
    """Lengths of zero or less, absent ones and ones beyond 2 ** 53 give what the SQL gives, null and not a number told apart."""
    import duckdb

    lengths = [0, None, 1, 32, 33, -1, -33, -64, 2**53 + 1, 2**62 + 1, 2**63 - 32, -(2**63)]
    spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r["doc_id"]: repr((r["h32"], r["scale"])) for r in QUERIES["ceil32_scale"](spark, str(tmp_path)).collect()}
    assert got == {i: repr((h, s)) for i, h, s in con.sql(SQL["ceil32_scale"]).fetchall()}
    assert got[0] == "(0, nan)" and got[1] == "(None, None)"


def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["page_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "source" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_llm(tmp_path):
    """As the driver does: without the subpackage and the pipeline the other queries are there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), "False"]


def test_only_absent_operators_are_passed_over(tmp_path):
    """A dependency that the subpackage lacks is an error, not a silent loss of its queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "pagemill" / "llm").mkdir()
    (tmp_path / "pagemill" / "llm" / "queries.py").write_text("import no_such_library\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode and "no_such_library" in said.stderr
