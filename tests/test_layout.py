"""The training-data subpackage is optional: nothing else may lean on it."""

import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_else_imports_it():
    for path in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(m.startswith("palimpsest.llm") or m == "corpus_pipeline" for m in imported(path)), path


def test_entry_without_it(tmp_path):
    for path in ROOT.rglob("*.py"):
        rel = path.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_latest' in q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})


def test_no_row_udfs_or_cross_joins():
    for path in (ROOT / "palimpsest").rglob("*.py"):
        text = path.read_text()
        assert "crossJoin" not in text and "localCheckpoint" not in text and "F.udf(" not in text, path
