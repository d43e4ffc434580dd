import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(where):
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, check=True).stdout.split()


def test_entry_imports_without_the_training_data_folder(tmp_path):
    for part in ("weftline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / part)
    (tmp_path / "weftline" / "llm").mkdir()  # a folder that is left without its files
    found = names(tmp_path)
    assert len(found) >= 61 and "pipeline" not in found and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in found)
    os.rmdir(tmp_path / "weftline" / "llm")
    os.remove(tmp_path / "corpus_pipeline.py") if os.path.exists(tmp_path / "corpus_pipeline.py") else None
    assert names(tmp_path) == found
