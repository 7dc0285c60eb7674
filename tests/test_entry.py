"""The driver contract with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as d; print(*sorted(d.queries()))"


def _queries(folder) -> set[str]:
    found = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True,
                           env=os.environ | {"PYTHONPATH": str(folder)})
    assert found.returncode == 0, found.stderr
    return set(found.stdout.split())


def _copy(folder, corpus: bool, pipeline: bool) -> set[str]:
    skipped = shutil.ignore_patterns("__pycache__", *([] if corpus else ["llm"]))
    shutil.copytree(os.path.join(ROOT, "imgaudit"), folder / "imgaudit", ignore=skipped)
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder)
    return _queries(folder)


def test_rest_registers_without_the_corpus_operators(tmp_path):
    bare = _copy(tmp_path / "bare", corpus=False, pipeline=False)
    left = _copy(tmp_path / "left", corpus=False, pipeline=True)
    assert len(bare) >= 100 and bare == left
    assert not [name for name in bare if name.startswith("op") or name == "pipeline"]
    assert bare <= _queries(ROOT)
