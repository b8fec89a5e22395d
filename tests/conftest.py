import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # Spark's Python workers too


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from orrery.engine import Engine

    e = Engine(spark, tmp_path / "root")
    for r in e.execute_script("CREATE DATABASE lab; USE lab"):
        assert r.success, r.message
    return e


@pytest.fixture
def rows(engine):
    """Runs a script that must work and gives the last result's rows as tuples."""

    def run(sql, e=None):
        results = (e or engine).execute_script(sql)
        assert results[-1].success, results[-1].message
        return [tuple(r.values()) for r in results[-1].rows]

    return run


@pytest.fixture
def fails(engine):
    def run(sql, e=None):
        results = (e or engine).execute_script(sql)
        assert not results[-1].success, f"{sql} should fail"
        return results[-1].message

    return run
