"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 3 and df.columns[:3] == ["month", "total", "n"]


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_alone():
    """Without the pipeline's packages the entry still imports and has the report engine's queries."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 120 and out[1] == "False"


def test_absent_tokenizers_leave_the_engine():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout) > 120


def test_faults_of_the_engine_are_not_hidden():
    code = "import sys; sys.modules['tallybook.functions.periods'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode != 0
