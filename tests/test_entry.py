"""Driver contract and the oracle keys."""

import os
import subprocess
import sys

import __spark_entry__ as E
from skiff.plans.queries import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module imports and lists its own queries where the training-data parts are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'skiff.llm') or name.startswith('skiff.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as E\n"
        "from skiff.plans.queries import QUERIES\n"
        "assert set(E.queries()) == set(QUERIES)\n"
    )
    root = os.path.dirname(os.path.abspath(E.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"event_type", "lines", "chars", "min_event_id", "max_event_id"}


def test_queries_in_a_bare_session():
    """Every query of the library's own against DuckDB, in a session without the settings that
    ``local_session`` makes."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    out = subprocess.run(
        [sys.executable, "tools/oracle_check.py", "/root/testdata/sf0.001", *QUERIES], cwd=root, capture_output=True, text=True, check=False
    )
    assert out.returncode == 0, out.stdout
