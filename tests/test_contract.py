from pathlib import Path

import __spark_entry__ as entry
from tidespine.plans.dataset import FEATURES, TIERS

ROOT = Path(__file__).resolve().parents[1]


def test_feature_counts():
    assert len(FEATURES) == len(set(FEATURES)) == 112
    assert len(TIERS["medium"]) == 112 and set(TIERS["short"]) < set(FEATURES) and set(TIERS["long"]) < set(FEATURES)
    assert sum(c.endswith("_30d") for c in TIERS["short"] if c.startswith(("cve", "cisa"))) == 0


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200


def test_no_machine_local_shortcuts():
    for f in (ROOT / "tidespine").rglob("*.py"):
        text = f.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, f
