import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'r0_departures_board' in q and set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


def names(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_queries_without_the_training_data_operators(tmp_path):
    for keep_pipeline in (True, False):
        folder = tmp_path / str(keep_pipeline)
        shutil.copytree(os.path.join(ROOT, "stopweave"), folder / "stopweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * keep_pipeline]:
            if os.path.exists(os.path.join(ROOT, name)):
                shutil.copy(os.path.join(ROOT, name), folder)
        assert names(folder) == "[]"
