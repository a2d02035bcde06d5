"""The registered queries on documents: leaked items and texts that are no prose."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ITEM = (
    "The reviewer traces every unchecked header from the gateway down to the ledger writer, notes which handler drops the "
    "nonce, and explains in plain terms why replaying yesterday's voucher still moves money between two closed accounts."
)
PROSE = (
    "We looked at the change this morning and it does what it says. There is one thing that I would like to see before it "
    "goes out, and that is a test for the case where the queue is empty, because that is where it broke the last time."
)
TABLE = "\n".join(f"{i}\t{i * 37 % 101}\t{i * 7.5}\t0x{i * 977:05x}" for i in range(40))
OTHER = [f"Item {k} asks about topic {k} with words w{k}a w{k}b w{k}c w{k}d w{k}e and so on until it ends at w{k}z." for k in range(20)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    documents = [(1, PROSE + "\n\n" + ITEM.upper() + "\n\n" + PROSE), (2, PROSE), (3, TABLE), (4, None), (5, " \n\t"), (6, ">\n> "), (7, PROSE + " " + ITEM[:40])]
    spark.createDataFrame(documents, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    items = [(10, ITEM), (11, None), *((20 + k, t) for k, t in enumerate(OTHER))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/eval_items.parquet")
    return d


def test_p7_and_p8_are_registered_and_right(spark, root):
    q = importlib.import_module("__spark_entry__").queries()
    assert [tuple(r) for r in q["p7_found"](spark, root).collect()] == [(1, 10)]
    assert sorted(r["doc_id"] for r in q["p8_found"](spark, root).collect()) == [3, 6]
    assert q["p8_statistics"](spark, root).count() == 7


@pytest.mark.parametrize("absent, passes", [("llm", True), ("llm/queries.py", False), ("llm/quality.py", False)])
def test_only_the_whole_subpackage_may_be_absent(tmp_path, absent, passes):
    here = Path(__file__).parent.parent.parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "orelode", tmp_path / "orelode", ignore=shutil.ignore_patterns("__pycache__"))
    gone = tmp_path / "orelode" / absent
    shutil.rmtree(gone) if gone.is_dir() else gone.unlink()
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert (run.returncode == 0) == passes
    assert ("s24_scores" in run.stdout) == passes and "p4_found" not in run.stdout
