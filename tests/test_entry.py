"""The driver contract with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(hide: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules.update(dict.fromkeys({hide!r}.split())); import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())


def test_queries_without_what_is_optional():
    core = names("knotweave.llm")
    assert "gr9_dependencies" in core and not any(x.startswith("op") or x == "pipeline" for x in core)
    assert names("knotweave.llm.queries corpus_pipeline") == core
    assert names("ahocorasick") == core
