import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("lexmill.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, No())
"""


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_works_without_the_subpackage():
    names = run(BLOCK + "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    assert "dense_topk_l2" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)


def test_entry_works_with_leftovers_of_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "lexmill" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert "dense_topk_l2" in out and "pipeline" not in out


def test_entry_works_without_a_library_of_the_subpackage():
    missing = BLOCK.replace('name.startswith(("lexmill.llm", "corpus_pipeline"))', 'name == "xxhash"')
    names = run(missing + "import __spark_entry__ as e; print(*e.queries())")
    assert "dense_topk_l2" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_library_does_not_import_the_subpackage():
    for p in (ROOT / "lexmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lexmill.llm" not in p.read_text(), p


def test_entry_query(spark, tmp_path):
    import __spark_entry__ as e

    if Path("/root/testdata/sf0.001").exists():
        assert e.entry(spark).count() > 0
