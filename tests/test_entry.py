"""The driver's functions with and without the llm part."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent
LIST = "import __spark_entry__ as e; print(' '.join(e.queries())); print(len(e.oracle_sql())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True).stdout.split("\n")
    return set(out[0].split())


def test_the_library_stands_without_the_llm_part(tmp_path):
    for name in ("textloom", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    whole = names(tmp_path)
    shutil.rmtree(tmp_path / "textloom/llm", ignore_errors=True)
    bare = names(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from textloom.llm import work\n")  # a pipeline that is left behind
    assert names(tmp_path) == bare and bare <= whole and not any(n.startswith("op") for n in bare) and "cleanse_corpus" in bare


def test_nothing_else_imports_the_llm_part():
    for path in [*ROOT.glob("textloom/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            assert "textloom.llm" not in path.read_text(), path
