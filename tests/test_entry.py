import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_the_rest_stands_without_the_llm_package():
    code = "import sys; sys.modules['tidemill.llm'] = None; import __spark_entry__ as e; assert 'p2_found' not in e.queries(); assert 'p1_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert not [p for p in (ROOT / "tidemill").rglob("*.py") if "llm" not in p.parts and "tidemill.llm" in p.read_text()]
