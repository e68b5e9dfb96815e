import json

from clausegrid import __main__ as cli


def test_review_of_a_folder(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text('# Services agreement\n\nContoso Ltd ("Supplier") serves.\n\n## Payment\n\nSupplier is paid in 30 days.\n')
    (docs / "b.md").write_text("# Notes\n\nNothing.\n")
    (tmp_path / "t.json").write_text(json.dumps({"domain": "c", "version": "v1", "topics": [{"id": "payment", "keywords": ["payment"]}]}))
    rule = lambda i, lam, **more: {"id": i, "lambda": lam, "predicate": 'input1.category == "payment"', "selector": {"kind": "path", "path": "$.sections[*]"}, **more}
    (tmp_path / "r.json").write_text(json.dumps({"id": "rs", "version": "1", "domain": "c", "rules": [
        rule("A", 'input1.text.Contains("Contoso Ltd is paid")'), rule("B", "true"), rule("K", "true", appliesToDocKinds=["contract"])]}))
    (tmp_path / "o.json").write_text(json.dumps({"ruleSetId": "rs", "ruleSetVersion": "1", "disabled": [{"ruleId": "B", "reason": "x"}]}))
    out = tmp_path / "out"
    cli.main(["review", str(docs), str(tmp_path / "r.json"), str(tmp_path / "t.json"), "--out", str(out), "--overlay", str(tmp_path / "o.json"), "--domain", "c", "--kinds"])
    verdicts = [json.loads(x["value"]) for x in spark.read.text(f"{out}/verdicts").collect()]
    assert sorted((v["rule_id"], v["outcome"]) for v in verdicts) == [("A", "Gap"), ("A", "Pass"), ("K", "Pass"), ("K", "Skipped")]
    assert spark.read.json(f"{out}/reports").count() == 2
    cli.main(["dump-tree", str(docs), "--out", f"{out}/tree"])
    assert sorted(r["title"] for r in spark.read.json(f"{out}/tree").collect()) == ["Notes", "Payment", "Services agreement"]
    cli.main(["rules-diff", str(tmp_path / "r.json"), str(tmp_path / "r.json"), "--out", f"{out}/diff"])
    assert {r["change"] for r in spark.read.json(f"{out}/diff").collect()} == {"unchanged"}
    cli.main(["parse", str(docs), "--out", f"{out}/blocks"])
    assert spark.read.json(f"{out}/blocks").count() == 6
