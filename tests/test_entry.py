import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_statements_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_core_stands_without_the_optional_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tallyard", tmp_path / "tallyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('p7') for k in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert "False" in out.stdout


def test_nothing_in_the_core_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/tallyard"):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as h:
                    text = h.read()
                assert "tallyard.llm" not in text and "from tallyard import llm" not in text, f


def test_command_line(capsys):
    from tallyard.__main__ import main

    assert main(["list"]) == 0
    assert "sta36_verdicts" in capsys.readouterr().out
