import ast
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_contract(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "degree", "strength"] and rows.count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_package():
    for f in (REPO / "thicket").rglob("*.py"):
        if f.parent.name != "llm":
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith(("thicket.llm", "corpus_pipeline")) for n in names), f
