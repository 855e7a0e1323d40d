import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from concord import bindings


def canonical(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows) if all(None not in r for r in rows) else sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    db = duckdb.connect()
    for file in os.listdir(small):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{small}/{file}'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = canonical([tuple(r[c] for c in cols) for r in df.collect()])
    want = canonical(db.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("absent", ["concord.llm", "corpus_pipeline", "zstandard", "xxhash", "regex", "public_tokenizers"])
def test_library_does_without_the_optional_subpackage(absent):
    """Nor does it need any module that only the subpackage needs."""
    code = f"import sys; sys.modules['{absent}'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=os.path.dirname(entry.__file__), check=False, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(bindings.QUERIES)), str(len(bindings.SQL))], done.stderr
