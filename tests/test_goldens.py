"""Frozen reports of a corpus that lies elsewhere: CLAUSEGRID_GOLDENS names its folder, of one folder a rule set with
``ruleset.json`` and a folder a document with ``source.md`` and ``expected-verdict.json``; CLAUSEGRID_TOPIC_MAPS names the
folder of ``<rule set's folder>.v1.json``. Outcome, address, error and remediation of every frozen verdict have to be met."""

import json
import os
from pathlib import Path

import pytest

from clausegrid import api
from clausegrid.operators import governance
from clausegrid.sources import store

GOLDENS, MAPS = os.environ.get("CLAUSEGRID_GOLDENS"), os.environ.get("CLAUSEGRID_TOPIC_MAPS")
FOLDERS = sorted(p.parent for p in Path(GOLDENS).glob("*/ruleset.json")) if GOLDENS and MAPS else []


@pytest.mark.skipif(not FOLDERS, reason="no corpus is named")
@pytest.mark.parametrize("folder", FOLDERS, ids=lambda p: p.name)
def test_frozen_reports_are_met(spark, folder):
    rules = store.load_ruleset(spark, str(folder / "ruleset.json"))
    found = api.review(spark, f"{folder}/*/source.md", rules, store.load_topic_map(spark, f"{MAPS}/{folder.name}.v1.json"))
    rows = {r["verdict_id"]: r for r in found["verdicts"].collect()}
    reports = found["reports"].collect()
    for path in folder.glob("*/expected-verdict.json"):
        want = json.loads(path.read_text())
        assert governance.ruleset_fingerprint(rules) == want["ruleSetFingerprint"]["value"]
        for v in want["verdicts"]:
            got = rows[v["id"]]
            assert (got["rule_id"], got["outcome"], got["section_id"], got["error"], got["remediation"]) == (v["ruleId"], v["outcome"], v.get("matchedSectionId"), v.get("errorMessage"), v.get("remediationText")), path
            if v["outcome"] == "Fail" and v.get("clauseSpan"):
                assert (got["clause_start"], got["clause_length"]) == (v["clauseSpan"]["charStart"], v["clauseSpan"]["charLength"])
        counts = (want["passed"], want["failed"], want["gaps"], want["errored"], want["notApplicable"], want["score"])
        assert any((r["passed"], r["failed"], r["gaps"], r["errored"], r["not_applicable"]) == counts[:5] and abs(r["score"] - counts[5]) < 1e-12 for r in reports if r["doc_id"] == want["documentId"]["value"])


def test_pretty_printed_files_are_read_whole(spark, tmp_path):
    """Rule sets, overlays and topic maps of many lines, with a byte order mark and names in either case."""
    rules = {"Id": "rs", "version": "1", "domain": "c", "rules": [{"id": "A", "lambda": 'input1.text.Contains("30")', "predicate": 'input1.category == "payment"', "sourceSpan": {"documentId": "p", "charStart": 1, "charLength": 2}}]}
    (tmp_path / "r.json").write_text("﻿" + json.dumps(rules, indent=2))
    (tmp_path / "o.json").write_text(json.dumps({"ruleSetId": "rs", "ruleSetVersion": "1", "disabled": [{"ruleId": "A", "reason": "x"}]}, indent=4))
    (tmp_path / "t.json").write_text(json.dumps({"domain": "c", "version": "v1", "topics": [{"id": "payment", "keywords": ["payment"]}], "amendmentPatterns": ["amends '([^']+)'"]}, indent=2))
    got = store.load_ruleset(spark, str(tmp_path / "r.json"))
    assert (got.id, got.rules[0].id, got.rules[0].source_start) == ("rs", "A", 1)
    assert [r["rule_id"] for r in store.load_overlay(spark, str(tmp_path / "o.json"), got).collect()] == ["A"]
    topics = store.load_topic_map(spark, str(tmp_path / "t.json"))
    assert topics.topics == (("payment", ("payment",)),) and topics.amendments == ("amends '([^']+)'",)
    (tmp_path / "d.md").write_text("# Payment terms\n\nPaid in 30 days.\n\n# Annex\n\nThis amends 'payment terms'.\n")
    verdicts = api.review(spark, str(tmp_path / "d.md"), got, topics)["verdicts"]
    assert sorted((r["section_id"], r["outcome"]) for r in verdicts.collect()) == [("s_00000000", "Pass"), ("s_00000001", "Fail")]
