from pyspark.sql import functions as F

from clausegrid.operators import clauses, project

TOPICS = project.TopicMap("t", (("miscellaneous", ("miscellaneous",)), ("law", ("governing law",)), ("payment", ("payment",))))
TEXT = ("Governing Law. These terms follow the laws of Ontario and no others at all.\nPayment Terms. Invoices are due within 30 days of receipt by the buyer, without fail.\n"
        "The Parties. Not a label, since it opens like a sentence does in most contracts that we read.")


def test_wrapper_parts_become_sections(spark):
    s = spark.createDataFrame([("d", 0, "s_00000000", "Miscellaneous", TEXT, 100), ("d", 1, "s_00000001", "Miscellaneous", "Short. Text", 500)], "doc_id string, ord int, section_id string, heading string, text string, char_start int")
    out = {r["section_id"]: r for r in clauses.expand_wrappers(project.enrich(s, TOPICS), TOPICS).collect()}
    assert set(out) == {"s_00000000", "s_00000001", "s_00000000_a", "s_00000000_b"}
    a, b = out["s_00000000_a"], out["s_00000000_b"]
    assert (a["category"], b["category"], b["parent_section"], b["text_features"]["day_counts"]) == ("law", "payment", "s_00000000", [30])
    assert TEXT[a["char_start"] - 100:].startswith("These terms") and not a["is_operative_for_topic"] and b["text"].startswith("Invoices")


def test_letters():
    assert [clauses.letters(k) for k in (0, 25, 26, 51, 52, 701, 702)] == ["a", "z", "aa", "az", "ba", "zz", "aaa"]


def test_durations_near_anchors(spark):
    near = clauses.duration_near
    assert near("The RTO is 4 hours. The RPO is 15 min.", "rto") == 14400 and near("The RTO is 4 hours. The RPO is 15 min.", "RPO") == 900
    assert near("RTO. Then 4 hours", "rto") is None and near(None, "x") is None and near("", "x") is None and near("rto 1,5 days, 2 wk", "rto") == 129600
    assert near("backup 3 days or recovery 2 hours", "recovery") == 7200 and near("a rto " + "x" * 200 + " 4 hours", "rto") is None
    got = spark.createDataFrame([("RTO 2 h",), (None,)], "t string").select(clauses.seconds_near(F.col("t"), "rto").alias("s")).collect()
    assert sorted(str(r["s"]) for r in got) == ["7200.0", "None"]


def test_outline_addresses(spark):
    rows = [("a", "T", 1, 0, 50), ("a", "U", 2, 10, 50), ("b", "T", 1, 0, 50), ("b", "U", 2, 10, 50), ("c", "T", 1, 0, 50), ("c", "V", 2, 10, 50)]
    tree = project.document_tree(spark.createDataFrame(rows, "doc_id string, title string, level int, start int, doc_end int"))
    same = {r["doc_id"]: r["fingerprint"] for r in clauses.tree_fingerprints(tree.withColumn("k", F.lit("k")).drop("k")).collect()}
    assert len(same) == 3 and all(v.startswith("lr1:") for v in same.values()) and len(set(same.values())) == 3
    one = tree.where("doc_id in ('a', 'c')").withColumn("doc_id", F.lit("x"))
    assert clauses.tree_fingerprints(one.where("title != 'V'").dropDuplicates(["node_id"])).count() == 1


def test_amendments_of_amendments_have_no_limit(spark):
    from clausegrid.operators import project

    topics = project.TopicMap("t", (("tax", ("gst",)),), amendments=(r"amends (\w+)",))
    made = [("d", 0, "s0", "gst k0x", "", 0)] + [("d", k, f"s{k}", f"k{k}x", f"amends k{k - 1}x", 0) for k in range(1, 9)] + [("d", 9, "s9", "other", "amends none", 0)]
    got = project.enrich(spark.createDataFrame(made, "doc_id string, ord int, section_id string, heading string, text string, char_start int"), topics, features=False)
    assert {r["ord"]: (r["primary_topic"], r["inherited_from"]) for r in got.collect()} == {0: ("tax", None), **{k: ("tax", f"s{k - 1}") for k in range(1, 9)}, 9: ("unknown", None)}
