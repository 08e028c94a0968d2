import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The other queries load and are the same when the llm folder and the pipeline are gone."""
    shutil.copytree(f"{ROOT}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    from quarry.catalogue import QUERIES

    assert out.stdout.split() == [str(len(QUERIES)), "False"]


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(f"{ROOT}/quarry"):
        if "/llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "quarry.llm" not in f.read(), name


def test_entry_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
