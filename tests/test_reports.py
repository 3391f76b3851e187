from __future__ import annotations

import json

import pytest

from codexmill import cli
from codexmill.operators.profile import standard_checks, summarise, value_states
from codexmill.plans.reports import REPORTS
from codexmill.streaming.states import compact_states, current_summary, profile_stream
from tests.test_audit import write
from tests.test_profile import SCHEMA, row


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("snap")
    crumb = '[{"type": "title", "num": "1", "label": "T 1"}, {"type": "section", "num": "1.2", "label": "S"}]'
    base = {"state": "US", "document_type": "regulation", "breadcrumb": crumb, "display_path": "R / T 1 / S x", "citation": "c|d", "act_status": "in_force", "word_count": 3}
    rows = [base | {"act_id": "CFR_1", "text": "a"}, base | {"act_id": "CFR_1", "text": "a"}, base | {"act_id": "FR_2", "text": None}, base | {"act_id": "CFR_3", "text": "[§2. Renumbered §5]", "act_status": "renumbered"}]
    write(d / "us_federal_regulations.parquet", rows)
    (d / "new").mkdir()
    write(d / "new" / "us_federal_regulations.parquet", rows[1:] + [base | {"act_id": "CFR_9", "text": "n"}])
    write(d / "new" / "us_ak_statutes.parquet", [])
    return d


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, files, name, tmp_path):
    out = tmp_path / "r.md"
    args = [name, str(files / "*.parquet"), "--snapshot", "v1", "--out", str(out)]
    assert cli.main(args) == 0
    first = out.read_text()
    assert first.startswith("# ") and "|" in first
    cli.main(args)
    assert out.read_text() == first
    if name == "identity-manifest":
        assert "| cfr_identity_v1 | provisional | 1 | 2 | 2 | 2 |" in first
    assert cli.main([name, str(files / "new" / "us_ak_statutes.parquet"), "--snapshot", "v1", "--out", str(out)]) == 0


def test_manifest_and_diff(spark, files, capsys):
    cli.main(["manifest", str(files / "*.parquet"), "--snapshot", "v1"])
    assert json.loads(capsys.readouterr().out)[0]["rows"] == 4
    cli.main(["diff", "--old", str(files / "*.parquet"), "--new", str(files / "new" / "us_federal_regulations.parquet")])
    out = capsys.readouterr().out
    assert "CFR_9" in out and "| renumbered | 1 | 1 | 1 |" in out
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_stream(spark, tmp_path):
    checks, rows = standard_checks(), [row(1 + i % 2, act_id=str(i % 5)) for i in range(20)]
    source, states = str(tmp_path / "in"), str(tmp_path / "states")
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        profile_stream(spark.readStream.schema(SCHEMA).parquet(source), "load_id", checks, states, str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(states)
    assert stored.select("batch").distinct().count() == 2
    want = sorted(map(str, summarise(value_states(spark.createDataFrame(rows, SCHEMA), "load_id", checks), checks).collect()))
    assert sorted(map(str, current_summary(stored, checks).collect())) == want
    compact_states(stored, str(tmp_path / "one"))
    assert sorted(map(str, current_summary(spark.read.parquet(str(tmp_path / "one")), checks).collect())) == want
