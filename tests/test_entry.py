"""The driver's contract and the independence of the core."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_nothing_else_imports_llm():
    for p in (ROOT / "paperloom").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "paperloom").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("paperloom.llm" in n for n in names), p


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "score", "search_type"]
    df.collect()
