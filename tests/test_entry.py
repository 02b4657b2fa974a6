import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    for path in (HERE / "quern").rglob("*.py"):
        if "llm" not in path.relative_to(HERE).parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text()


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    code = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'contextual_search' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
