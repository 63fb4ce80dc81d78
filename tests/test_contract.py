"""The driver contract: import without a session, results equal to the independent engine."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from leeward.plans.catalog import all_queries
from parity import check, engine

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_entry_module_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_module_loads_where_an_empty_folder_is_left_of_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "leeward", tmp_path / "leeward", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.corpus_pipeline is None and len(e.queries()) > 70"
    for left in ("leeward/llm/__pycache__", "corpus_pipeline.py"):
        (tmp_path / left).mkdir(parents=True) if left.endswith("__") else (tmp_path / left).write_text("raise RuntimeError('not to be read')")
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_entry(spark):
    import __spark_entry__
    out = __spark_entry__.entry(spark)
    assert out.columns == ["device_id", "quality_status", "n_readings", "n_alerts"] and out.count() > 0


@pytest.fixture(scope="module")
def duck():
    return engine(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, duck, name):
    verdict, _ = check(spark, duck, all_queries()[name], FOLDER)
    assert verdict.startswith("ok"), verdict
