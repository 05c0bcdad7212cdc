"""Every registered query of the run grid against its SQL twin, and that the entry module stands without the optional parts."""

import subprocess
import sys
import uuid
from pathlib import Path

import duckdb
import pytest

from runweave import plans
from runweave.plans import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql_twin(spark, con, name):
    got, want = plans.queries()[name](spark, SF), con.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(map(shown, r)) for r in got.select(columns).collect())
    b = sorted(tuple(map(shown, r)) for r in want.project(", ".join(columns)).fetchall())
    assert a == b


@pytest.mark.parametrize(("name", "folders"), [("log_zone_table", "logs"), ("stream_growing_logs", "growing")])
def test_log_files_lie_on_disk_a_lot_at_a_time(spark, con, tmp_path, monkeypatch, name, folders):
    """Lots of some 70 blocks give what all runs together give; a lot's files are gone before the next one's come."""
    lots, delete = [], ingest.deleted

    def counted(*places):
        found = [p.name for p in tmp_path.rglob("*.log")]
        lots.extend([found] if found else [])
        delete(*places)

    monkeypatch.setattr(ingest, "scratch", lambda _, what: f"file://{tmp_path}/{what}-{uuid.uuid4().hex}")
    monkeypatch.setattr(ingest, "BLOCKS", 70)
    monkeypatch.setattr(ingest, "deleted", counted)
    got, want = plans.queries()[name](spark, SF), con.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    a = sorted(tuple(map(shown, r)) for r in got.select(columns).collect())
    b = sorted(tuple(map(shown, r)) for r in want.project(", ".join(columns)).fetchall())
    assert a == b
    runs = [n for lot in lots for n in lot]
    assert len(lots) > 2 and len(runs) == len(set(runs)) and max(map(len, lots)) < len(runs) and {p.rsplit(".", 1)[0] for p in runs} >= {r[columns.index("file")] for r in a}
    assert not list(tmp_path.rglob("*.log")) and not list(tmp_path.glob(f"{folders}-beside-*"))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_nothing_else_imports_the_optional_subpackage():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "runweave").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_entry_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('runweave.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
