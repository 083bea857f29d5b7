"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    ours = entry.queries()[name](spark, FOLDER).toArrow()
    assert ours.num_rows > 0
    check = entry.oracle_sql().get(name)
    if check is not None:
        assert compare(ours, connection.execute(check).to_arrow_table()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


_ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from tests.conftest import make_session
spark = make_session()
print(entry.entry(spark).count(), entry.queries()["decode_packets"](spark, sys.argv[2]).count())
spark.stop()
"""


def test_entry_from_a_foreign_folder(tmp_path):
    """Python workers find the package though it is not below the working folder."""
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run(
        [sys.executable, "-c", _ELSEWHERE, repo, FOLDER], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert made.stdout.split()[-2:] == ["1000", "1000"], made.stderr[-2000:]
