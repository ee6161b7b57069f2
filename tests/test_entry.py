"""The entry points with and without the training-data package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys
sys.modules['weftline.llm'] = sys.modules['corpus_pipeline'] = None
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert 'activity_yearly' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q), sorted(q)
assert set(s) <= set(q)
"""


def test_without_the_training_data_package():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
