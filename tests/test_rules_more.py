"""Leaves and order of selectors, errors of single rows, anchors and vectors in rules, overlays, kinds, tokens, Word spans."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausegrid import __main__ as cli
from clausegrid import api
from clausegrid.functions import arrays, primitives
from clausegrid.functions.vectors import hash_vector
from clausegrid.operators import authoring, evaluate, facts, governance, overlays, project, semantic
from clausegrid.operators.evaluate import Options, Rule, RuleSet
from clausegrid.plans import selectors
from clausegrid.sources import documents, docx

DOC = {"a": [1, {"b": None, "c": "x"}, []], "d": {}, "e": {"f": [[2], "y z"]}, "s": [{"i": k} for k in range(12)]}


def test_leaves_and_their_complement(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), ("3",), ("null",), (None,)], "j string").select(F.parse_json("j").alias("doc"))
    d = F.col("doc")
    paths = lambda found: F.transform(found, lambda x: x["path"])
    own = lambda x, at="$": [at] if not isinstance(x, (dict, list)) else [p for k, v in (x.items() if isinstance(x, dict) else enumerate(x)) if v is not None for p in own(v, f"{at}.{k}" if isinstance(x, dict) else f"{at}[{k}]")]
    rows = df.select(paths(selectors.leaves(d)), paths(selectors.regex_nodes(d, None, "[xy]")), paths(selectors.select_not(d, selectors.json_matches(d, "$.s[*].i")))).collect()
    assert [list(r[0]) for r in rows] == [sorted(own(DOC)), ["$"], [], []]
    assert list(rows[0][1]) == ["$.a[1].c", "$.e.f[1]"] and list(rows[0][2]) == ["$.a[0]", "$.a[1].c", "$.e.f[0][0]", "$.e.f[1]"]
    ten = df.limit(1).select(paths(selectors.json_matches(d, "$.s[*]"))).first()[0]
    assert list(ten) == sorted(f"$.s[{k}]" for k in range(12)) and ten[1] == "$.s[10]"
    deep = spark.createDataFrame([("[" * 80 + "1" + "]" * 80,)], "j string").select(F.parse_json("j").alias("doc"))
    with pytest.raises(Exception, match="nested deeper"):
        deep.select(selectors.leaves(F.col("doc"))).collect()


def test_spans_are_looked_up_towards_the_root(spark):
    spans = F.create_map(F.lit("$"), F.lit(0), F.lit("$.a[1]"), F.lit(7))
    df = spark.createDataFrame([("$.a[1].c",), ("$.a[1]",), ("$.a[12]",), ("$",)], "p string")
    assert [r[0] for r in df.select(selectors.span_of(F.col("p"), spans)).collect()] == [7, 7, 0, 0]


def test_running_totals(spark):
    rows = [[], [5], list(range(63)), list(range(64)), list(range(65)), list(range(1000)), None]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, a array<int>").select("k", arrays.running_totals(F.col("a")).alias("t")).collect()
    assert all((r["t"] is None) if rows[r["k"]] is None else list(r["t"]) == [sum(rows[r["k"]][:i]) for i in range(len(rows[r["k"]]))] for r in got)


V = {"law": [1.0, 0.0], "tax": [0.0, 1.0]}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("d", 0, "s0", "Law", "The law holds.", 0, [1.0, 0.0]), ("d", 1, "s1", "Tax", "Tax is paid.", 20, [0.0, 1.0]), ("d", 2, "s2", "None", "Nothing.", 40, None)]
    return spark.createDataFrame(rows, "doc_id string, ord int, section_id string, heading string, text string, char_start int, embedding array<double>")


def outcomes(sections, lam, options, predicate="true", **more):
    rules = RuleSet("r", "1", (Rule("A", lam, predicate, **more),))
    return {r["section_id"]: (r["outcome"], r["error"]) for r in evaluate.evaluate(sections, rules, options).collect()}


def test_missing_vectors_are_errors_of_their_rows(vectors):
    o = Options(meaning=semantic.meaning("embedding", V))
    got = outcomes(vectors, 'ContainsMeaning(input1.id, "law", 0.9)', o)
    assert got["s0"][0] == "Pass" and got["s1"][0] == "Fail" and got["s2"][0] == "Error" and "law" in got["s2"][1]
    got = outcomes(vectors, 'MatchesAnyMeaning(input1.id, "law|gone", 0.9)', o)  # what is missing behind a hit is not noticed
    assert (got["s0"][0], got["s1"][0], got["s2"][0]) == ("Pass", "Error", "Error")
    got = outcomes(vectors, 'MatchesAnyMeaning(input1.id, "gone|law", 0.9)', o)
    assert {x[0] for x in got.values()} == {"Error"}
    got = outcomes(vectors, 'input1.text.Contains("Nothing") || ContainsMeaning(input1.id, "law", 0.9)', o)  # not reached
    assert (got["s0"][0], got["s1"][0], got["s2"][0]) == ("Pass", "Fail", "Pass")
    got = outcomes(vectors, "true", o, '!ContainsMeaning(input1.id, "law", 0.9)')
    assert got["s2"][1].startswith("predicate: ") and got["s1"][0] == "Pass" and "s0" not in got
    assert {x[0] for x in outcomes(vectors, 'ContainsMeaning(input1.id, "law", 0.9)', Options()).values()} == {"Error"}


ANCHORED = dict(anchors=({"name": "rto", "anchorText": "recovery time", "threshold": 0.99}, {"name": "rpo", "anchorText": "recovery point", "threshold": 0.99, "ngram": [2]}, {"name": "uni", "anchorText": "recovery point", "ngram": [1]}))


def test_anchors_are_bound_and_asked_for(spark):
    texts = ["The recovery time is 4 hours. The recovery point, 15 min.", "The recovery point is 2.5 days, then 9.", "None of it. RTO 3 h"]
    s = spark.createDataFrame([("d", k, f"s{k}", "H", t, 0, k == 2, "rto") for k, t in enumerate(texts)], "doc_id string, ord int, section_id string, heading string, text string, char_start int, is_synthetic_anchor boolean, synthetic_anchor string")

    want = {
        'SemanticBindings("rto").Count > 0': "PFF", 'SemanticBindings("rpo").Count >= 1': "PPF", 'SemanticBindings("uni").Count > 0': "FFF",
        'ExtractNumberNear(input1.text, SemanticBindings("rpo"), 40) == 2.5': "FPF",
        'NearestText(input1.text, SemanticBindings("rto"), 4).Contains("is 4")': "FFF", 'NearestText(input1.text, SemanticBindings("rto"), 5).Contains("is 4")': "PFF",
        'ResolveAnchorSpan("rto").CharStart == 4': "PFF", 'ResolveAnchorSpan("rto", input1.text).CharStart == 12': "FFP",
        'ExtractDurationNear(input1.text, "rto").TotalHours <= 4': "PFP", 'ExtractDurationNear(input1.text, "rpo").Value.TotalMinutes == 15': "PFF",
        'HasExtractedDurationNear(input1.text, "rpo", 30)': "PPF",
        "HasSyntheticAnchor(input1)": "FFP", 'HasSyntheticAnchor(input1, "rpo")': "FFF", 'HasSyntheticAnchor(input1, "rto")': "FFP"}
    rules = RuleSet("r", "1", tuple(Rule(f"R{k:02d}", lam, **ANCHORED) for k, lam in enumerate(want)))
    bound = semantic.bind(s, rules, hash_vector, stopwords=["the"]).cache()
    rows = evaluate.evaluate(bound, rules, Options(bindings_col="__bindings")).collect()
    for k, (lam, marks) in enumerate(want.items()):
        assert "".join(r["outcome"][0] for r in sorted(rows, key=lambda r: r["section_id"]) if r["rule_id"] == f"R{k:02d}") == marks, lam
    one = RuleSet("r", "1", (Rule("R00", "true", **ANCHORED),))
    assert [r["outcome"] for r in evaluate.evaluate(bound, one, Options(bindings_col="__bindings", least_anchors=2)).orderBy("section_id").collect()] == ["Pass", "NotApplicable", "NotApplicable"]


def test_topics_by_anchor(spark):
    s = spark.createDataFrame([("d", 0, "s0", "H", "recovery time", 0, ["x"], {"x": 0.4}), ("d", 1, "s1", "H", "none", 0, ["x"], {"x": 0.9})], "doc_id string, ord int, section_id string, heading string, text string, char_start int, topics array<string>, topic_scores map<string,double>")
    rules = RuleSet("r", "1", (Rule("A", 'HasTopic(input1, "x", 0.5, "rto")', **ANCHORED), Rule("B", 'HasTopic(input1, "x", 0.5)', **ANCHORED)))
    bound = semantic.bind(s, rules, hash_vector)
    assert sorted((r["rule_id"], r["section_id"], r["outcome"]) for r in evaluate.evaluate(bound, rules, Options(bindings_col="__bindings")).collect()) == [("A", "s0", "Pass"), ("A", "s1", "Pass"), ("B", "s0", "Fail"), ("B", "s1", "Pass")]


def test_tokens_with_places_by_plain_python(spark):
    import re

    texts = ["The recovery point is 4 hours. Recovery time objective, 12 days! End-user's view", "", "... ...", "One word", "a b. c d? e\nf g.h i", None, "recovery recovery recovery"]
    s = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "section_id string, text string")
    stop = ["the", "is"]
    want = set()
    for k, t in enumerate(texts):
        raw, at = [], 0
        for sentence in re.split(r"(?<=[.!?])\s+", t or ""):
            at = (t or "").index(sentence, at)
            words = [(m[0].lower(), at + m.start(), at + m.end()) for m in re.finditer(r"[^\W_][^\W_'\-]*(?:['\-][^\W_'\-]*)*", sentence)]
            words = [w for w in words if w[0] not in stop and not re.fullmatch(r"\d{1,2}", w[0])]
            raw += [(" ".join(w[0] for w in words[i:i + n]), n, words[i][1], words[i + n - 1][2] - words[i][1]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
            at += len(sentence)
        for token, n in {r[:2] for r in raw}:
            own = sorted(r[2:] for r in raw if r[:2] == (token, n))
            want.add((f"s{k}", token, n, len(own), *own[0]))
    assert {tuple(r) for r in semantic.section_tokens(s, stop, (1, 2, 3)).collect()} == want
    assert semantic.section_tokens(s, stop, (1,), limit=1).where("section_id = 's0'").first()["token"] == "recovery"


def test_kinds_by_word_path_and_vote(spark):
    rows = [(" arb ", "x/samples/contracts/a.md", "fsi"), ("", "C:\\Rulesets\\Contracts\\a.md", "fsi"), (None, "a.md", "fsi"), (None, None, None)]
    got = spark.createDataFrame(rows, "e string, p string, v string").select(project.resolve_kind(F.col("e"), F.col("p"), F.col("v")).alias("k")).collect()
    assert [r["k"] for r in got] == ["arb", "contract", "fsi", "unknown"]


RULES = RuleSet("rs", "2", (Rule("A", 'input1.text.Contains("30")', 'input1.category == "payment"', evidence_quote="q", source_document="p"), Rule("B", "true", evidence_quote=" "), Rule("C", "true", evidence_quote="q", source_document="(unknown)")))


def test_overlays_are_edited_with_reasons():
    o = overlays.disable(overlays.empty(RULES), RULES, "A", "old", "me")
    o = overlays.disable(o, RULES, "A", "older")
    o = overlays.annotate(o, RULES, "B", "note")
    assert [(d["ruleId"], d["reason"]) for d in o["disabled"]] == [("A", "older")]
    assert overlays.fingerprint(o) == overlays.fingerprint(o | {"createdBy": "x"}) == overlays.address("overlay", "rs", "2", "disable:A|older", "note:B|note") != overlays.fingerprint(overlays.enable(o, RULES, "A"))
    assert overlays.enable(overlays.enable(o, RULES, "A"), RULES, "A")["disabled"] == [] and overlays.show(RULES, "A")["lambda"] == 'input1.text.Contains("30")'
    for bad in (lambda: overlays.disable(o, RULES, "A", " "), lambda: overlays.disable(o, RULES, "Z", "x"), lambda: overlays.annotate(o, RuleSet("rs", "3", ()), "A", "x")):
        with pytest.raises(ValueError):
            bad()


def test_rules_that_cannot_be_traced(spark):
    got = {r["rule_id"]: r["problem"] for r in governance.structural_problems(governance.rule_rows(spark, RULES)).collect()}
    assert got == {"B": "missing evidenceQuote", "C": "missing or unknown sourceSpan.documentId"}


def test_outline_by_plain_stacks(spark):
    import random

    rnd = random.Random(4)
    rows = [(f"d{d}", f"t{k}", rnd.randint(1, 5), 10 * k + 1, 400) for d in range(8) for k in range(rnd.randint(1, 25))]
    got = {(r["doc_id"], r["start"]): (r["parent_id"], r["end"]) for r in project.document_tree(spark.createDataFrame(rows, "doc_id string, title string, level int, start int, doc_end int")).collect()}
    for d, _, level, start, end in rows:
        above = [r for r in rows if r[0] == d and r[3] < start and r[2] < level]
        below = [r for r in rows if r[0] == d and r[3] > start and r[2] <= level]
        assert got[d, start] == (f"n_{above[-1][3]:08x}" if above else None, below[0][3] if below else end)


def test_fact_rules_read_facts_once(spark):
    f = spark.createDataFrame([("d", f"s{k}", c, v) for k, c, v in [(0, "a", "1"), (1, "a", "3"), (1, "b", "x"), (2, "c", "y")]], "doc_id string, section_id string, concept string, value string")
    rules = RuleSet("r", "1", tuple(Rule(f"R{k:02d}", "facts.a <= 2", mode="facts", required_facts=("a",)) for k in range(30)) + (Rule("S", "facts.a == 3", mode="facts"), Rule("T", 'facts.c == "y"', mode="facts", required_any=("b", "c"))))
    out = facts.evaluate_fact_rules(f, f, rules, {"a": "int"}, {"S": ["s1"]})
    assert {r["rule_id"]: r["outcome"] for r in out.collect()} == {**{f"R{k:02d}": "Pass" for k in range(30)}, "S": "Pass", "T": "Pass"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_many_rules_are_one_pass(spark):
    s = spark.createDataFrame([("d", k, f"s{k}", "H", f"text {k}", 0, "payment" if k % 2 else "law") for k in range(6)], "doc_id string, ord int, section_id string, heading string, text string, char_start int, category string")
    rules = RuleSet("r", "1", tuple(Rule(f"R{k:03d}", f'input1.text.Contains("{k % 7}")', 'input1.category == "payment"') for k in range(130)))
    out = evaluate.evaluate(s, rules)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {(r["rule_id"], r["section_id"]): r["outcome"] for r in out.collect()}
    assert got == {(f"R{k:03d}", f"s{n}"): "Pass" if str(k % 7) == str(n) else "Fail" for k in range(130) for n in (1, 3, 5)}


def word_file(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    runs = lambda p: "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>' for t in p)
    body = "".join(f"<w:p>{runs(p)}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
        z.writestr("[Content_Types].xml", "<Types></Types>")
    return out.getvalue()


@pytest.mark.parametrize("start,length,gone", [(0, 5, "First"), (6, 4, "part"), (4, 8, "t part o"), (11, 8, "of it.\nS"), (18, 6, "Second")])
def test_replacements_cover_their_span_alone(start, length, gone):
    from xml.etree import ElementTree as ET

    w = docx._W
    made = docx.annotate_docx(word_file(["First  pa", "rt ", " of it."], ["Second one."]), [{"comment_id": 1, "kind": "replace", "start": start, "length": length, "text": "NEW"}])
    doc = ET.fromstring(zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml"))
    deleted = " ".join("".join(t.text for t in doc.iter(f"{w}delText")).split())
    paragraphs = doc.findall(f".//{w}p")
    first = 0 if start < 18 else 1
    own = (gone.split("\n")[0])
    assert deleted == " ".join(own.split())
    whole = ["First part of it.", "Second one."]
    at = start - (18 if first else 0)
    kept = "".join(t.text or "" for t in paragraphs[first].iter(f"{w}t"))
    assert " ".join(kept.split()) == " ".join((whole[first][:at] + "NEW" + whole[first][at + len(own):]).split()).replace("NEW ", "NEW ") or kept.replace(" ", "") == (whole[first][:at] + "NEW" + whole[first][at + len(own):]).replace(" ", "")
    assert "".join(t.text or "" for t in paragraphs[1 - first].iter(f"{w}t")).split() == whole[1 - first].split()


def test_command_line_on_rule_sets(spark, tmp_path, capsys):
    rules = {"id": "rs", "version": "1", "domain": "c", "rules": [{"id": "A", "lambda": 'input1.text.Contains("x")', "predicate": 'input1.category == "payment"', "naturalLanguage": "Says x.", "examples": {"positive": ["Says x."], "negative": ["No."]},
             "semanticAnchors": [{"name": "n", "anchorText": "some text"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(rules, indent=2))
    (tmp_path / "t.json").write_text(json.dumps({"id": "t", "topics": [{"id": "payment", "keywords": ["pay"]}, {"id": "other", "keywords": ["o"]}]}, indent=2))
    r, out = str(tmp_path / "r.json"), str(tmp_path / "out")
    cli.main(["rules-disable", r, "A", "--reason", "old", "--by", "me", "--out", f"{out}/o.json"])
    assert json.loads((tmp_path / "out/o.json").read_text())["disabled"][0]["reason"] == "old"
    cli.main(["rules-annotate", r, "A", "--overlay", f"{out}/o.json", "--note", "n", "--out", f"{out}/o2.json"])
    cli.main(["rules-enable", r, "A", "--overlay", f"{out}/o2.json", "--out", f"{out}/o3.json"])
    held = json.loads((tmp_path / "out/o3.json").read_text())
    assert held["disabled"] == [] and held["annotations"][0]["note"] == "n"
    cli.main(["rules-show", r, "A"])
    cli.main(["topic-map", str(tmp_path / "t.json")])
    assert '"fingerprint": "lr1:' in (shown := capsys.readouterr().out) and '"payment"' in shown
    cli.main(["index", r, "--out", f"{out}/index"])
    cli.main(["topic-coverage", r, str(tmp_path / "t.json"), "--out", f"{out}/cover"])
    assert spark.read.json(f"{out}/cover").first()["unused"] == ["other"]
    cli.main(["ruleset-validate", r, "--out", f"{out}/valid"])
    assert spark.read.json(f"{out}/valid/margins").first()["accepted"] and spark.read.json(f"{out}/valid/problems").count() == 1
    cli.main(["ruleset-reembed-anchors", r, "--out", f"{out}/anchors"])
    assert len(spark.read.json(f"{out}/anchors").first()["embedding"]) == 32


def test_reviews_with_vectors_and_policies_to_rules(spark, tmp_path):
    (tmp_path / "d.md").write_text("# Payment\n\nPaid in 30 days.\n\n# Recovery\n\nThe recovery time is 4 hours.\n")
    topics = project.TopicMap("t", (("payment", ("payment",)), ("ghost", ("ghost",))))
    rules = RuleSet("r", "1", (Rule("A", 'SemanticBindings("rto").Count > 0 && ExtractDurationNear(input1.text, "rto").TotalHours <= 4', 'input1.text.Contains("recovery")', **ANCHORED),
                               Rule("M", 'ContainsMeaning(input1.id, "Paid in 30 days.", 0.99)', 'input1.category == "payment"'), Rule("G", "HasSyntheticAnchor(input1)", 'input1.category == "ghost"')), domain="c")
    anchors = spark.createDataFrame([("ghost", "g", [float(x) for x in spark.range(1).select(hash_vector(F.lit("Paid in 30 days."))).first()[0]])], "topic string, anchor string, vector array<double>")
    found = api.review(spark, str(tmp_path / "d.md"), rules, topics, embed=hash_vector, anchors=anchors, kind="note")
    got = {(r["rule_id"], r["section_id"]): r["outcome"] for r in found["verdicts"].collect()}
    assert got == {("A", "s_00000001"): "Pass", ("M", "s_00000000"): "Pass", ("G", "s_synthetic_ghost_0001"): "Pass"}
    made, counts = api.extract_rules(spark, str(tmp_path), [authoring.Template("PAY", ("paid",), 'input1.text.Contains("paid")')], "P-", 5)
    row = made.collect()
    assert len(row) == 1 and row[0]["rule_id"].startswith("P-") and row[0]["rule_id"].endswith("-PAY-001") and row[0]["source_length"] == len("Paid in 30 days.")
    assert counts.first()["blocks_examined"] >= 2
    kinds = {r["file_name"]: r["problem"] for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert kinds == {"d.md": None}


def test_numbers_and_texts_around_bindings(spark):
    bound = F.lit(None).cast(primitives.BINDINGS)
    df = spark.range(1)
    assert df.select(primitives.nearest_text(F.lit("abc"), bound).alias("t")).first()["t"] == "" and str(df.select(primitives.number_near_bindings(F.lit("1"), bound).alias("n")).first()["n"]) == "nan"
    assert df.select(primitives.anchor_span(bound, "x").alias("a")).first()["a"] is None


PROPOSAL = {"ruleId": "ABC-1", "naturalLanguage": "Says something.", "predicate": "true", "lambda": "true", "concepts": ["one", "two", "three"], "severity": "Warning", "applicability": "Optional",
            "remediation": "Write what is missing.", "evidenceQuote": "q", "sourceSpan": {"documentId": "d", "charStart": 0, "pageNumber": None}, "examples": {"positive": ["x" * 16] * 3, "negative": ["y" * 16] * 3}, "metadata": {"a": "b"}}


def test_proposed_rules_are_checked_by_field(spark):
    cases = [
        (PROPOSAL, []), (PROPOSAL | {"ruleId": "a"}, ["ruleId"]), (PROPOSAL | {"severity": "Bad", "naturalLanguage": "short"}, ["naturalLanguage", "severity"]), (PROPOSAL | {"concepts": ["one", "two", "th"]}, ["concepts"]),
        ({k: v for k, v in PROPOSAL.items() if k != "metadata"}, ["metadata"]), (PROPOSAL | {"more": 1}, ["unknown field"]), (PROPOSAL | {"sourceSpan": {"documentId": "d", "charStart": -1, "x": 1}}, ["sourceSpan", "unknown field in sourceSpan"]),
        (PROPOSAL | {"examples": {"positive": ["x" * 16] * 2, "negative": ["y" * 16] * 3}}, ["examples.positive"]), (PROPOSAL | {"metadata": {"a": 1}}, ["metadata"]), (PROPOSAL | {"lambda": 3}, ["lambda"])]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(100, "no json"), (101, "[]"), (102, None)]
    got = {r["k"]: list(r["p"]) for r in spark.createDataFrame(rows, "k int, j string").select("k", authoring.proposal_problems(F.col("j")).alias("p")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases] and got[100] == got[101] == got[102] == ["no JSON object"]


def test_batches_of_records_are_answered_in_order(spark):
    body = {"values": [{"recordId": "2", "data": {"chunk": "text", "documentId": "d", "headingPath": "/h"}}, {"recordId": 'a"1', "data": {"chunk": "more", "parentDocumentId": "p"}}, {"recordId": "3", "data": {"chunk": " "}}]}
    records = authoring.skill_records(spark.createDataFrame([(1, json.dumps(body))], "request_id int, body string"))
    answers = spark.createDataFrame([(1, "2", json.dumps(PROPOSAL)), (1, 'a"1', "{}")], "request_id int, record_id string, answer string")
    got = json.loads(authoring.skill_responses(records, answers).first()["body"])["values"]
    assert [v["recordId"] for v in got] == ["2", 'a"1', "3"] and got[0]["data"]["rule"] == PROPOSAL and got[0]["errors"] == []
    assert got[1]["data"] == {} and len(got[1]["errors"]) == 3 and got[2]["errors"] == [{"message": "empty chunk"}]


def test_templates_name_what_sections_have(spark):
    s = spark.createDataFrame([("d", 0, "s0", "H", "/H", "First one. Then two.", 0, "c", 2.5)], "doc_id string, ord int, section_id string, heading string, heading_path string, text string, char_start int, category string, density double")
    rules = RuleSet("r", "1", (Rule("A", "false", remediation="{section.headingPath}|{section.firstSentence}|{section.id}|{section.density}|{input.density}|{input.gone}|{meta.k}", metadata={"k": 7}),))
    assert evaluate.evaluate(s, rules).first()["remediation"] == "/H|First one.|s0|{section.density}|2.5|{input.gone}|7"
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.0,), (0.12345,), (100.0,), (0.0,)], "v double").select(primitives.format_number(F.col("v"))).collect()] == ["2.5", "3", "0.1235", "100", "0"]


def test_searches_go_in_blocks(spark, monkeypatch):
    from clausegrid.operators import sized

    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 3), 1.0]) for k in range(60)], "item_id int, embedding array<double>")
    queries = rows.select(F.col("item_id").alias("query_id"), "embedding")
    whole = {tuple(r) for r in semantic.top_k(queries, rows, 3).select("query_id", "item_id", "rank").collect()}
    monkeypatch.setattr(semantic, "blocks", lambda q, key: sized.blocks(q, key, 7))
    assert {tuple(r) for r in semantic.top_k(queries, rows, 3).select("query_id", "item_id", "rank").collect()} == whole and len(whole) == 180
    assert semantic.top_k(queries.limit(0), rows, 3).count() == 0
    assert sized.sized(rows, 10) is rows


def test_tables_are_made_once(spark, tmp_path):
    from clausegrid.sources import store

    made = []

    def make(df):
        made.append(sorted(r["k"] for r in df.collect()))
        return df.select("k", (F.col("k") * 2).alias("v"))

    ask = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    path = str(tmp_path / "t")
    assert sorted(map(tuple, store.cached(ask(1, 2), path, ["k"], make).collect())) == [(1, 2), (2, 4)]
    assert sorted(map(tuple, store.cached(ask(2, 3), path, ["k"], make).collect())) == [(2, 4), (3, 6)]
    assert made == [[1, 2], [3]]
    texts = spark.createDataFrame([(" A  b ",), ("c",), ("c",)], "text string")
    cache = spark.createDataFrame([("a b", [9.0])], "key string, embedding array<double>")
    got = {r["text"]: r["embedding"] for r in semantic.embed_distinct(texts, hash_vector, cache=cache).collect()}
    assert got[" A  b "] == [9.0] and len(got["c"]) == 32
