import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).columns
    assert any(q.startswith("p1_") for q in queries) == ("ridgeline.llm.queries" in entry.MODULES)


def test_core_does_not_import_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1] / "ridgeline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "ridgeline.llm" not in p.read_text(), p
