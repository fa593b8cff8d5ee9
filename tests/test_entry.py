import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from glossaria.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())


def test_imports_without_the_optional_part(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "glossaria"), tmp_path / "glossaria", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'corpus_vocabulary' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path), os.environ.get("PYTHONPATH")]))}  # what the caller has there stays
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_words.py", "tests/test_entry.py", "-k", "by_hand or corpus_vocabulary or push_summary"], cwd=tmp_path, check=True, env=env)
