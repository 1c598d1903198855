"""The folder of intermediate tables, and the state of input files."""

import subprocess
import sys
from pathlib import Path

from recurra import session

ROOT = Path(__file__).resolve().parents[1]


def test_local_session_without_a_folder_gets_one():
    # A session of its own, whose configuration names no folder.
    code = """
from pyspark.sql import SparkSession
from recurra.session import materialize, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert shared_dir(spark) == shared_dir(spark)
assert materialize(spark.range(5), "t").count() == 5
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_folders_are_kept_by_application(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Other:
        conf, sparkContext = Conf(), spark.sparkContext

    monkeypatch.setattr(session, "_LOCAL_FOLDERS", {})
    assert session.shared_dir(Other()) == session.shared_dir(Other())
    assert Path(session.shared_dir(Other())).is_dir()


def test_fingerprint_follows_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    first = session.fingerprint(spark, str(tmp_path))
    assert first == session.fingerprint(spark, str(tmp_path))
    (tmp_path / "a/y").write_text("22")
    assert first != session.fingerprint(spark, str(tmp_path))
