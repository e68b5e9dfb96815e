"""The rule engine: language, selectors, projection, evaluation, facts, governance, files, streams."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausegrid.functions import durations, primitives, textfeatures, vectors
from clausegrid.operators import annotate, authoring, evaluate, facts, governance, project, semantic
from clausegrid.operators.evaluate import Options, Rule, RuleSet
from clausegrid.plans import expression as ex
from clausegrid.plans import selectors
from clausegrid.sources import documents, docx, store
from clausegrid.streaming import review

TEXTS = st.sampled_from(['input1.text.Contains("a")', 'input1.category == "x"', "input1.n > 2", "input1.n <= -1", 'input1.gone == "x"', "input1.gone != null", "input1.n == null", 'input1.topics.Contains("t")',
                         "input1.topics.Count >= 2", 'input1.text.ToLower().StartsWith("b")', "input1.text.Length < 3", "true", "false"])
EXPRS = st.recursive(TEXTS, lambda e: st.one_of(st.tuples(e, st.sampled_from(["&&", "||"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), e.map(lambda x: f"!({x})")), max_leaves=6)
ROWS = [("ab", "x", 3, ["t", "u"]), ("Ba", "y", None, []), ("", None, -5, ["u"]), (None, "x", 0, None), ("b", "x", 2, ["t"])]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, text string, category string, n int, topics array<string>").cache()


def test_columns_mean_what_the_interpreter_says(values):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(EXPRS, min_size=8, max_size=8))
    def check(texts):
        names = set(values.columns)
        env = ex.Env(lambda p: F.col(p[1]) if len(p) > 1 and p[1] in names else None, frozenset({"topics"}))
        trees = [ex.parse(t) for t in texts]
        got = values.select("k", *(ex.truth(t, env).alias(f"e{i}") for i, t in enumerate(trees))).collect()
        for r in got:
            row = dict(zip(("text", "category", "n", "topics"), ROWS[r["k"]]))
            assert [r[f"e{i}"] for i in range(len(trees))] == [bool(ex.run(t, row)) for t in trees], (texts, row)

    check()


@pytest.mark.parametrize("bad", ["input1.text.Contains(", '"open', "a ? b", "(true", "true true", "input1."])
def test_bad_expressions_are_rule_errors(bad):
    with pytest.raises(ex.RuleError):
        ex.parse(bad)


def test_builder_and_literals():
    b = ex.Build.section().text_contains('say "hi"').and_(ex.Build.field("n").at_most(3).not_())
    assert str(b) == '(input1.text.Contains("say \\"hi\\"") && !(input1.n <= 3))'
    assert ex.literals(ex.parse(str(b))) == ['say "hi"']


def json_paths(spark, doc, found):
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("doc"))
    return [r for r in df.select(F.transform(found(F.col("doc")), lambda x: x["path"]).alias("p")).first()["p"]]


DOC = {"sections": [{"c": "x", "n": 5, "in": {"v": None}}, {"c": "y", "n": "high"}, {"n": 7.5, "c": None}, {"c": "x", "n": 9, "in": {"v": 1}}]}


@pytest.mark.parametrize("path,want", [
    ("$.sections[*].c", [0, 1, 3]), ("$.sections[1].n", [1]), ("$.sections[?(@.c == 'x')]", [0, 3]), ("$.sections[?(@.c != 'x')]", [1, 2]), ("$.sections[?(@.missing != 'x')]", []),
    ("$.sections[?(@.n < 6)]", [0, 1]), ("$.sections[?(@.n >= 7.5)]", [2, 3]), ("$.sections[?(@.c == null)]", [2]), ("$.sections[?(@.c =~ '^[xy]$')]", [0, 1, 3]), ("$.sections[?(@.in.v == 1)]", [3]), ("$.none[*]", [])])
def test_json_paths(spark, path, want):
    assert [int(p.split("[")[1].split("]")[0]) for p in json_paths(spark, DOC, lambda d: selectors.json_matches(d, path))] == want


def test_json_selectors(spark):
    assert json_paths(spark, DOC, lambda d: selectors.has_field(d, "$.sections[*].in", "v")) == ["$.sections[0].in", "$.sections[3].in"]
    both = lambda d: (selectors.json_matches(d, "$.sections[*]"), selectors.json_matches(d, "$.sections[?(@.n > 6)]"))
    assert json_paths(spark, DOC, lambda d: selectors.select_all(*both(d))) == ["$.sections[2]", "$.sections[3]"]
    assert json_paths(spark, DOC, lambda d: selectors.select_any(*reversed(both(d)))) == ["$.sections[0]", "$.sections[1]", "$.sections[2]", "$.sections[3]"]
    assert json_paths(spark, DOC, lambda d: selectors.select_all()) == []


def test_text_features(spark):
    text = "Pay within thirty days or 45 calendar days; forty-five (45) days.\nLate fees of 18% per annum, 1.5% per month.\nCyber cover of $2.5M and USD 1,000,000; notice of ten days, 24 months, two fiscal years."
    f = textfeatures.text_features(F.lit(text))
    r = spark.range(1).select(*(c.alias(n) for n, c in f.items())).first()
    assert r["day_counts"] == [10, 30, 45] and r["month_counts"] == [24] and r["year_counts"] == [2]
    assert r["percent_values"] == [1.5, 18.0] and r["percent_max_per_month"] == 1.5 and r["percent_min_per_month"] == 1.5
    assert r["dollar_amounts"] == [1_000_000, 2_500_000] and r["dollar_for_cyber"] == 2_500_000 and r["dollar_for_gcl"] == 0
    assert r["day_count_for_payment"] == 45 and r["day_count_for_notice"] == 0
    empty = spark.range(1).select(*(c.alias(n) for n, c in textfeatures.text_features(F.lit(None).cast("string")).items())).first()
    assert empty["day_counts"] == [] and empty["dollar_max"] == 0


def test_primitives_and_durations(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    t = F.lit("The plan is TBD.")
    assert one(primitives.is_template_boilerplate(t)) and not one(primitives.is_template_boilerplate(F.lit("  ")))
    assert one(primitives.regex_match(F.lit("a\nB"), "a.b")) and not one(primitives.regex_match(F.lit(""), "a"))
    assert one(primitives.count_prose_sentences(F.lit("One two three four five six seven eight. Short one. See 6.4.1 for all that we ever said here."))) == 2
    assert one(primitives.number_near(F.lit("the rto is 4.5 hours"), "RTO", 20)) == 4.5 and one(primitives.number_near(F.lit("none"), "rto", 20)) != one(primitives.number_near(F.lit("none"), "rto", 20))
    days = lambda s: one(durations.to_days(F.lit(s)))
    assert [days(s) for s in ("Quarterly.", "every 45 days", "P3W", "p10d", "PT5H", "now", "every 0 days", "on a 14-day rotation")] == [90, 45, 21, 10, None, None, None, 14]
    assert one(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert abs(one(vectors.cosine(vectors.hash_vector(F.lit("a")), vectors.hash_vector(F.lit("a")))) - 1) < 1e-9


MARKDOWN = """# Agreement

> Quoted **words**.

## 1. Payment

Buyer pays
in *30 days*.

- first item
- second `code`

## 2. Governing Law

Laws of Ontario.
"""
TOPICS = project.TopicMap("t.v1", (("payment", ("payment",)), ("law", ("governing law", "laws of"))), (("jurisdiction", ("ontario",)),), (r"amends (?:the )?'([^']+)'",))


@pytest.fixture(scope="module")
def sections(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "a.md").write_text("﻿" + MARKDOWN.replace("\n", "\r\n"), newline="")
    (folder / "b.pdf").write_bytes(b"%PDF")
    files = documents.read_files(spark, str(folder))
    return project.enrich(project.group_by_heading(documents.blocks(files)), TOPICS).cache()


def test_markdown_to_sections(spark, sections):
    rows = sections.orderBy("ord").collect()
    assert [(r["section_id"], r["heading"], r["text"]) for r in rows] == [
        ("s_00000000", "Agreement", "Quoted words."), ("s_00000001", "1. Payment", "Buyer paysin 30 days.\nfirst item\nsecond code"), ("s_00000002", "2. Governing Law", "Laws of Ontario.")]
    assert [r["primary_topic"] for r in rows] == ["unknown", "payment", "law"] and rows[1]["heading_path"] == "/Agreement/1. Payment"
    assert rows[1]["char_start"] == MARKDOWN.index("Buyer") and rows[1]["text_features"]["day_counts"] == [30]


def test_unparsed_files_carry_a_problem(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"x")
    (tmp_path / "y.md").write_text("y")
    got = {r["file_name"]: r["problem"] for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": "no parser for pdf", "y.md": None}


RULES = RuleSet("rs", "1", (
    Rule("A", 'input1.text.Contains("30")', 'input1.category == "payment"', natural_language="Thirty.", remediation="See {section.heading} / {rule.id} / {x.y}"),
    Rule("B", 'input1.text.Contains("Quebec")', 'input1.category == "law"', natural_language="Quebec.", remediation="See {section.heading} / {rule.id} / {x.y}"),
    Rule("C", "true", 'input1.category == "none"', natural_language="None."), Rule("D", "true", 'input1.category == "none"', applicability="Optional"),
    Rule("E", 'Nope(input1.text)', 'input1.category == "law"'), Rule("F", "true", "((", natural_language="Broken.")), domain="contract")


def test_outcomes_and_report(sections):
    got = {(r["rule_id"], r["section_id"]): r for r in evaluate.evaluate(sections, RULES).collect()}
    assert {k: v["outcome"] for k, v in got.items()} == {
        ("A", "s_00000001"): "Pass", ("B", "s_00000002"): "Fail", ("C", None): "Gap", ("D", None): "NotApplicable", ("E", "s_00000002"): "Error",
        ("F", "s_00000000"): "Error", ("F", "s_00000001"): "Error", ("F", "s_00000002"): "Error"}
    assert got["B", "s_00000002"]["remediation"] == "See 2. Governing Law / B / {x.y}" and got["B", "s_00000002"]["error"] == "Rule 'B' failed: Quebec."
    a, b = got["A", "s_00000001"], got["B", "s_00000002"]
    assert (a["start"], a["length"], a["clause_length"]) == (MARKDOWN.index("## 1. Payment"), len("## 1. Payment"), None) and got["F", "s_00000000"]["error"].startswith("predicate: ")
    assert (b["clause_start"], b["clause_length"]) == (MARKDOWN.index("Laws of"), len("Laws of Ontario."))
    r = evaluate.report(evaluate.evaluate(sections, RULES)).first()
    assert (r["passed"], r["failed"], r["gaps"], r["errored"], r["not_applicable"]) == (1, 1, 1, 4, 1) and abs(r["score"] - 1 / 3) < 1e-12
    with pytest.raises(ValueError):
        evaluate.require_domain("privacy", RULES)
    with pytest.raises(ValueError):
        evaluate.require_embedder("m2", RuleSet("r", "1", (), embedder="m1"))


def test_shuffled_rows_give_the_same_verdicts(sections):
    v = lambda s: sorted(map(str, evaluate.evaluate(s, RULES).collect()))
    assert v(sections) == v(sections.orderBy(F.desc("ord")).repartition(3))


def test_amendments_inherit_along_a_chain(spark):
    s = spark.createDataFrame([("d", 0, "s0", "Payment terms", "pay", 0), ("d", 1, "s1", "Schedule", "This amends 'Payment terms'.", 5), ("d", 2, "s2", "Annex", "It amends the 'Schedule'.", 9), ("d", 3, "s3", "Last", "amends 'old payment rules'", 20)],
                              "doc_id string, ord int, section_id string, heading string, text string, char_start int")
    got = {r["section_id"]: (r["primary_topic"], r["inherited_from"]) for r in project.enrich(s, TOPICS, features=False).collect()}
    assert got == {"s0": ("payment", None), "s1": ("payment", "s0"), "s2": ("payment", "s1"), "s3": ("payment", "<by-title>")}


def test_aliases(spark):
    b = spark.createDataFrame([("d", 0, 'Contoso Ltd ("Company") and Beta Corp ("Supplier"), a Corp'), ("d", 1, 'Other Inc ("Company")')], "doc_id string, block_ord int, text string")
    found = project.party_aliases(b)
    assert {(r["alias"], r["canonical"]) for r in found.collect()} == {("Company", "Contoso Ltd"), ("Supplier", "Beta Corp")}
    held = found.groupBy("doc_id").agg(F.collect_list(F.struct("alias", "canonical")).alias("a"))
    assert held.select(project.apply_aliases(F.lit("Company's duty, Companyx, Supplier"), F.col("a")).alias("t")).first()["t"] == "Contoso Ltd's duty, Companyx, Beta Corp"


def test_facts(spark):
    f = spark.createDataFrame([("d", "s2", "days", "P30D"), ("d", "s1", "days", "quarterly"), ("d", "s3", "days", "soon"), ("d", "s1", "ok", "no"), ("d", "s2", "ok", "TRUE"), ("d", "s2", "who", "b"), ("d", "s1", "who", "a"), ("d", "s1", "n", None)],
                              "doc_id string, section_id string, concept string, value string")
    kinds = {"days": "duration", "ok": "bool", "who": "text", "n": "int"}
    got = {r["concept"]: (r["value"], r["conflicts"]) for r in facts.merge_facts(f, kinds).collect()}
    assert got == {"days": ("30", 1), "ok": ("true", 1), "who": ("a", 1)}
    rules = RuleSet("r", "1", (Rule("X", "facts.days <= 30 && facts.ok == true", mode="facts", required_facts=("days",)), Rule("Y", "true", mode="facts", required_any=("n", "z"))))
    assert {r["rule_id"]: (r["outcome"], r["error"]) for r in facts.evaluate_fact_rules(f, f, rules, kinds).collect()} == {"X": ("Pass", None), "Y": ("NotApplicable", "missing_required_facts_any:n,z")}


def test_governance(spark):
    rows = governance.rule_rows(spark, RULES)
    assert governance.deduplicate(rows).count() == 5  # C and D decide alike
    active, audit = governance.apply_overlay(rows, spark.createDataFrame([("A", "x"), ("Z", "y")], "rule_id string, reason string"))
    assert active.count() == 5 and audit.first().asDict() == {"dropped": 1, "unknown": ["Z"]}
    assert governance.ruleset_fingerprints(rows).first()["fingerprint"] == governance.ruleset_fingerprint(RULES)
    assert governance.signature(RULES.rules[0]) == [("eq", "category", "payment")] and governance.signature(Rule("q", "true")) == []


def test_prefilter_admits_what_rules_decide(sections):
    plain, narrow = (sorted(map(str, evaluate.evaluate(sections, RuleSet("rs", "1", RULES.rules[:4]), Options(prefilter=p)).collect())) for p in (False, True))
    assert plain == narrow


def test_authoring(spark):
    got = authoring.validate_candidates(spark.createDataFrame([("TAX", "q", "a q b", 'input1.text.Contains("x")', "n"), ("tax", "q", "a q b", "x", "n"), ("TAX", "z", "a q b", "x", "n"), ("TAX", "q", "a q b", "Exit()", "n")],
                                                              "slug string, quote string, chunk string, lambda string, natural_language string"))
    assert sorted(str(r["problem"]) for r in got.collect()) == ["None", "lambda", "quote", "slug"]
    calls = authoring.with_client(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string"), lambda t: {"a": "A"}[t])
    assert sorted((str(r["text"]), str(r["answer"])) for r in calls.collect()) == [("None", "None"), ("a", "A"), ("a", "A"), ("b", "None")]


def word_file(paragraphs):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_word_files_in_and_out(spark, tmp_path):
    raw = word_file([("Heading1", "Terms"), ("", "Pay now."), ("ListParagraph", "Item")])
    assert [(b[0], b[1], b[5]) for b in documents.docx_blocks(raw)] == [("heading", "Terms", "/Terms"), ("paragraph", "Pay now.", "/Terms"), ("list_item", "Item", "/Terms"), ("table_cell", "cell", "/Terms/table/r0/c0")]
    (tmp_path / "a.docx").write_bytes(raw)
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    files = documents.read_files(spark, str(tmp_path))
    assert documents.blocks(files).count() == 4
    doc = files.where("file_name = 'a.docx'").first()["doc_id"]
    notes = spark.createDataFrame([(doc, 1, "comment", 6, 3, "why now"), (doc, 2, "replace", 6, 3, "Pay later."), (doc, 3, "comment", 900, 3, "nowhere")], "doc_id string, comment_id int, kind string, start int, length int, text string")
    out = docx.reviewed_docx(files, notes).collect()
    assert len(out) == 1
    with zipfile.ZipFile(io.BytesIO(bytes(out[0]["content"]))) as z:
        body, said = z.read("word/document.xml").decode(), z.read("word/comments.xml").decode()
    assert "<w:del " in body and "Pay later." in body and "why now" in said and "nowhere" not in said
    assert docx.annotate_docx(raw, []) == docx.annotate_docx(raw, [])


def test_store(spark, tmp_path):
    spec = {"Id": "r", "Version": "2", "Domain": "d", "Rules": [{"Id": "A", "Lambda": "true", "Severity": "Warning"}]}
    (tmp_path / "r.json").write_text(json.dumps(spec))
    rules = store.load_ruleset(spark, str(tmp_path / "r.json"))
    assert rules.rules[0].severity == "Warning" and rules.version == "2"
    (tmp_path / "o.json").write_text(json.dumps({"ruleSetId": "r", "ruleSetVersion": "1", "disabled": []}))
    with pytest.raises(ValueError):
        store.load_overlay(spark, str(tmp_path / "o.json"), rules)
    out = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    store.insert_new(rows((1, "a"), (1, "b")), out, ["k"])
    store.insert_new(rows((1, "c"), (2, "d")), out, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2]
    store.publish(rows((1, "x")), str(tmp_path / "p"), ["k"])
    store.publish(rows((2, "y")), str(tmp_path / "p"), ["k"])
    store.publish(rows((1, "z")), str(tmp_path / "p"), ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "z"), (2, "y")]
    assert store.newest(["a.v1", "a.v2", "b"], "a") == "a.v2" and store.newest(["a"], "x") is None


def test_stream_reviews_each_document_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("Payment. It is 30.",), ("Other.",), ("Other.",), (None,)], "text string").write.parquet(src)
    for _ in range(2):
        q = review.review_stream(spark.readStream.schema("text string").parquet(src), RuleSet("rs", "1", RULES.rules[:1]), TOPICS, str(tmp_path / "out"), str(tmp_path / f"ck{_}"))
        q.awaitTermination()
    reports = spark.read.parquet(f"{tmp_path}/out/reports").collect()
    assert sorted((r["passed"], r["gaps"]) for r in reports) == [(0, 1), (1, 0)]


def test_search_and_matches(spark):
    e = spark.createDataFrame([(k, [float(k == 0), float(k == 1), 1.0]) for k in range(4)], "id int, embedding array<double>")
    q = e.where("id < 2").select(F.col("id").alias("query_id"), "embedding")
    got = semantic.top_k(q, e.select(F.col("id").alias("item_id"), "embedding"), 2).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == {(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 2, 2)}
    v = F.array(F.lit(1.0), F.lit(0.0))
    hit, error = semantic.matches_any(v, [v, F.lit(None).cast("array<double>")], 0.5)
    assert spark.range(1).select(hit.alias("h"), error.alias("e")).first().asDict() == {"h": True, "e": None}
    hit, error = semantic.matches_any(v, [F.lit(None).cast("array<double>"), v], 0.5)
    assert spark.range(1).select(hit.alias("h"), error.alias("e")).first().asDict() == {"h": False, "e": "missing vector"}


def test_annotations_are_numbered_in_reading_order(spark, sections):
    sev = governance.rule_rows(spark, RULES).select("rule_id", "severity")
    notes = annotate.comment_ids(annotate.annotations(evaluate.evaluate(sections, RULES), sev, rewrites=True)).orderBy("comment_id").collect()
    assert [n["comment_id"] for n in notes] == list(range(1, len(notes) + 1)) and notes == sorted(notes, key=lambda n: (n["start"], n["annotation_id"]))
    assert {n["kind"] for n in notes} == {"comment", "replace", "summary"}
