"""What has to hold around the queries: where files go, and an llm subpackage that cannot be imported."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from vecloom.session import shared_dir

ROOT = Path(__file__).resolve().parent.parent


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_dir(fake("spark://host:7077", "hdfs://x/tmp/")) == "hdfs://x/tmp"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(fake("spark://host:7077"))
    assert shared_dir(fake("local[2]")).startswith("file://")


@pytest.mark.parametrize("failure", ["ModuleNotFoundError(name='vecloom.llm')", "ImportError('numpy')", "SyntaxError('x')"])
def test_entry_without_llm(failure):
    code = f"""
import builtins, importlib, sys, warnings
warnings.simplefilter('ignore')
real = importlib.import_module
def broken(name, *a):
    if name.startswith('vecloom.llm'):
        raise {failure}
    return real(name, *a)
importlib.import_module = broken
import __spark_entry__ as e
q = e.queries()
assert 'knn_exact' in q and 'p2_found' in q and 'p1_found' not in q
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
