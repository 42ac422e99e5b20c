"""The driver imports __spark_entry__ in a process without Spark's jars or a session."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import builtins, glob, io, zipfile
def refuse(*a, **k):
    raise AssertionError('import looked for a file: %r' % (a,))
glob.glob = zipfile.ZipFile = refuse
import __spark_entry__ as e
from pyspark import SparkContext
assert SparkContext._gateway is None and SparkContext._active_spark_context is None
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 45 and len(o) >= 43, (len(q), len(o))
assert set(o) <= set(q)
print('ok')
"""


def test_import_needs_no_jar_and_no_session():
    env = os.environ | {"SPARK_HOME": "/nonexistent", "PYTHONPATH": ROOT}
    r = subprocess.run([sys.executable, "-c", PROBE], cwd="/", env=env,
                       capture_output=True, text=True, timeout=120)
    assert r.returncode == 0 and r.stdout.strip().endswith("ok"), r.stderr[-2000:]


HIDDEN = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in %r or name in %r:
            raise ModuleNotFoundError('hidden', name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 45 and set(o) <= set(q), len(q)
assert not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q)
print('ok')
"""


def test_missing_library_or_subpackage_costs_only_its_queries():
    for libraries in (["xxhash"], ["sentiscope.llm", "corpus_pipeline"]):
        env = os.environ | {"PYTHONPATH": ROOT}
        r = subprocess.run([sys.executable, "-c", HIDDEN % (libraries, libraries)], cwd="/", env=env,
                           capture_output=True, text=True, timeout=120)
        assert r.returncode == 0 and r.stdout.strip().endswith("ok"), r.stderr[-2000:]
