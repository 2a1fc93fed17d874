import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

BLOCKED = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("evospark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and not [n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    others = [p for p in (ROOT / "evospark").rglob("*.py") if "llm" not in p.relative_to(ROOT / "evospark").parts]
    assert others and not [p for p in others if "evospark.llm" in p.read_text()]


def test_every_check_belongs_to_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
