"""Planted defects are found, clean data stays silent, reruns agree, findings cite what is there."""

import json

import numpy as np
import pandas as pd
import pytest

from sparkeda import api
from sparkeda.assist import Decision, Investigator, ScriptedProvider, parse_decision
from sparkeda.model import DataLoadError, Evidence, Finding, UnsupportedSourceError, sort_findings
from sparkeda.privacy import PrivacyPolicy
from sparkeda.sources.loaders import format_options, load_tables, table_name


@pytest.fixture(scope="module")
def accounts(spark):
    rng = np.random.default_rng(7)
    n = 200
    f = pd.DataFrame({"account_id": np.arange(n), "plan": rng.choice(["free", "pro", "Pro "], n), "seats": rng.lognormal(3, 0.5, n).round(), "when": pd.date_range("2024-01-01", periods=n, freq="D")})
    f["spend"] = f.seats * 3 + rng.normal(0, 5, n)
    f["copy"] = f.spend * 12
    f["note"] = ["n/a" if i % 3 == 0 else f"text {i}" for i in range(n)]
    f["churned"] = (f.seats > 20).astype(int)
    f.loc[5, "seats"] = 5000
    return api.load({"accounts": f})


def titles(r):
    return [f.title for f in r.findings]


def cites(r):
    known = {e.id for e in r.evidence}
    return all(set(f.evidence_ids) <= known for f in r.findings)


def test_profile_finds_planted_defects_and_reruns_agree(accounts, tmp_path):
    one, two = (accounts.profile(now="2025-01-01") for _ in range(2))
    assert "accounts.plan writes one label in several ways" in titles(one) and "accounts.note hides missing values" in titles(one)
    assert cites(one) and not one.failures
    assert json.dumps(one.to_dict(), sort_keys=True) == json.dumps(two.to_dict(), sort_keys=True)
    html = one.to_html(tmp_path / "r.html").read_text()
    assert "<svg" in html and "http://" not in html and "https://" not in html
    assert json.loads(one.to_json(tmp_path / "r.json").read_text())["goal"] == "profile"


def test_clean_table_is_silent(spark):
    rng = np.random.default_rng(1)
    r = api.profile(pd.DataFrame({"a": rng.normal(size=120), "b": rng.choice(["x", "y"], 120)}), now="2025-01-01")
    assert r.issues == [] and r.status == "completed"


@pytest.mark.parametrize("frame", [pd.DataFrame({"a": pd.Series([], dtype=float), "b": pd.Series([], dtype=str)}), pd.DataFrame({"a": [np.nan] * 5, "b": ["x"] * 5}), pd.DataFrame({"a": [1.0], "b": ["x"]})])
def test_degenerate_tables(spark, frame):
    r = api.profile(spark.createDataFrame(frame, "a double, b string"), now="2025-01-01")
    assert not r.failures and r.status in ("completed", "completed_with_warnings", "insufficient_evidence")


def test_regression_leak_is_found_and_left_out_of_the_probe(accounts):
    r = accounts.regression(target="spend", mode="quick")
    assert "Potential target leakage: copy" in titles(r) and cites(r) and not r.failures
    probe = next(e for e in r.evidence if e.kind == "regression_probe")
    assert "copy" not in probe.columns and "account_id" not in probe.columns


def test_classification(accounts):
    r = accounts.classification(target="churned", mode="quick")
    assert "Identifier-like feature: account_id" in titles(r) and cites(r) and not r.failures
    assert accounts.classification().status == "insufficient_evidence"
    assert accounts.classification(target="nothing").warnings[0].code == "classification_target_not_found"


def test_anomaly(accounts):
    r = accounts.anomaly_detection()
    assert any(t.endswith("row(s) to review in accounts") for t in titles(r)) and not r.failures
    with pytest.raises(ValueError):
        accounts.anomaly_detection(expected_contamination=0.7)


def test_time_series_outage(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"day": pd.date_range("2024-01-01", periods=200, freq="D"), "orders": 100 + 30 * np.sin(np.arange(200) * 2 * np.pi / 7) + rng.normal(0, 1, 200)})
    f = f.drop(index=range(50, 58))
    r = api.time_series(f, value="orders", now="2025-01-01")
    assert "8 period(s) were never recorded" in titles(r) and "Clear seasonality" in titles(r) and not r.failures


def test_clustering_gate(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [20, 20], [0, 20]])
    f = pd.DataFrame(np.concatenate([rng.normal(c, 1, (60, 2)) for c in centres]), columns=["x", "y"])
    r = api.clustering(f, mode="quick")
    assert "3 groups reproduce on resampled rows" in titles(r)
    noise = api.clustering(pd.DataFrame(rng.uniform(size=(150, 2)), columns=["x", "y"]), mode="quick")
    assert noise.status == "no_meaningful_structure"


def test_schema_orphans(spark):
    customers = pd.DataFrame({"customer_id": range(1, 11), "segment": list("ab") * 5})
    orders = pd.DataFrame({"order_id": range(20), "customer_id": [*range(1, 11), *range(1, 10), 999], "amount": np.arange(20.0)})
    r = api.discover_schema({"customers": customers, "orders": orders}, min_relationship_inclusion=0.9)
    link = next(e.value for e in r.evidence if e.kind == "schema_relationship_candidate")
    assert link["orphan_rows"] == 1 and round(link["inclusion"], 6) == round(10 / 11, 6)
    assert "Possible orphan rows in orders" in titles(r)
    assert api.discover_schema(customers).status == "insufficient_evidence"


def test_compare(spark):
    a, b = pd.DataFrame({"x": range(5), "y": list("aabbc")}), pd.DataFrame({"x": range(3, 8), "y": list("bbccd")})
    r = api.compare_datasets({"t": a}, {"u": b})
    assert [w.code for w in r.warnings] == ["table_name_mismatch"] and len(r.evidence) == 2
    assert api.compare_datasets({"t": a, "v": a}, {"u": b, "w": b}).warnings[0].code == "no_common_tables"


def test_loaders(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_csv(tmp_path / "one.csv", index=False)
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "two.parquet")
    assert sorted(load_tables(str(tmp_path))) == ["one", "two"]
    assert sorted(load_tables(str(tmp_path), include=["*.csv"], names={"one": "first"})) == ["first"]
    assert load_tables(str(tmp_path / "one.csv"))["one"].count() == 2
    assert table_name("/x/one.csv", {"one.csv": "n"}) == "n"
    assert format_options("csv", {"csv": {"sep": ";"}}) == {"sep": ";"} and format_options("parquet", {"csv": {"sep": ";"}}) == {}
    with pytest.raises(UnsupportedSourceError):
        load_tables(3)
    with pytest.raises(DataLoadError):
        load_tables(str(tmp_path / "none.csv"))["none"].count()
    with pytest.raises(DataLoadError):
        load_tables(pd.DataFrame([[1, 2]], columns=["a", "a"]))
    with pytest.raises(DataLoadError):
        load_tables({})


def test_goals_and_options(accounts):
    with pytest.raises(NotImplementedError):
        accounts.analyze("poetry")
    with pytest.raises(TypeError):
        accounts.profile(unknown=1)
    with pytest.raises(ValueError):
        accounts.analyze("profile", mode="slow")


def test_investigator_drops_what_cites_nothing(accounts):
    seen = accounts.profile(now="2025-01-01")
    answers = ['{"tool": "profile_dataset", "arguments": {"now": "2025-01-01"}}', json.dumps({"tool": "finish", "findings": [{"title": "made up", "evidence_ids": ["ev_none"]}, {"title": "real", "evidence_ids": [seen.evidence[0].id]}]})]
    r = Investigator(accounts, ScriptedProvider(answers)).start("look").run()
    assert "real" in titles(r) and "made up" not in titles(r)
    r = Investigator(accounts, ScriptedProvider(['{"tool": "list_tables"}'] * 9), max_steps=2).start("look").run()
    assert r.warnings[0].code == "investigator_not_converged"
    assert parse_decision("well: {\"tool\": \"x\"} ok") == Decision("x") and parse_decision("no").tool is None


def test_privacy():
    p = PrivacyPolicy(columns={"a": "redact", "b": "alias", "c": "exclude"})
    assert p.safe_name("a") == "[redacted]" and p.safe_name("b").startswith("column_") and p.safe_name("c") is None and p.safe_name("d") == "d"
    assert p.describe("d", {"column": "d", "n": 1, "top_values": [1]}) == {"column": "d", "n": 1}


def test_model():
    a, b = Evidence("k", {"x": 0.1 + 0.2}), Evidence("k", {"x": 0.3}, description="other words", confidence=0.5)
    assert a.id == b.id
    with pytest.raises(ValueError):
        Finding("t", "high", ())
    assert [f.severity for f in sort_findings([Finding("b", "low", ("e",)), Finding("a", "high", ("e",))])] == ["high", "low"]


def test_events_survive_a_failing_observer(accounts):
    kinds = []

    def bad(event):
        raise RuntimeError

    accounts.clustering(features=["none"], callbacks=[bad, lambda e: kinds.append(e["kind"])])
    assert kinds[0] == "analysis_started" and kinds[-1] == "analysis_completed"
