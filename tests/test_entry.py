"""The driver's functions."""

import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"lang", "tokens", "harmonic", "syllables"}


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_llm(tmp_path):
    """What is left imports if the subpackage and the pipeline are taken away."""
    code = "import sys, importlib.abc\n" + (
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lalespark.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [k for k in e.queries() if k.startswith('op')]\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
