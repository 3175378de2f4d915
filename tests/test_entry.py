import ast
import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_can_be_named_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 50


def test_nothing_imports_the_training_data_package():
    for path in (ROOT / "lexmill").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_reports_equal_their_sql(spark, sf_dir):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("status_pivot", "top_courts", "provider_mix", "deadlines", "legal_references", "tfidf_topk", "throttle_window", "dense_topk"):
        a, b = queries[name](spark, sf_dir).toPandas(), c.execute(sql[name]).fetchdf()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        rows = lambda p: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in p[cols].astype(object).values.tolist())
        assert rows(a) == rows(b), name
