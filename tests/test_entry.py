import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from quarryline.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_every_catalogue_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_does_without_the_llm_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "quarryline"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    lib = tmp_path / "quarryline"
    lib.mkdir()
    for p in (ROOT / "quarryline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (lib / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trend_per_part' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=False)
    assert said.returncode == 0, said.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "quarryline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
