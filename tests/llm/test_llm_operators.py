"""The operators over small tables with every awkward row: nulls, empty, very long, tied and repeated rows, other columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausegrid.llm import attribution, bpe, common, decontaminate, graph, htmlextract, lm, packing, quality, sharding, simhash, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
FORM = "doc_id long, text string, lang string, source string, n_chars long, shard string, id string, fp string, row string, word string, key string"


def rows():
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice([f"w{k}" for k in range(300)], rng.integers(12, 60))) + "." for _ in range(60)]
    out = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", None][k % 3]) for k, t in enumerate(base)]
    out += [(100 + k, base[k], "en", "s1") for k in range(8)]  # copies
    out += [(120 + k, base[9] + f" extra{k}", "en", "s1") for k in range(3)]
    out += [(200, None, "en", "s1"), (201, "", None, None), (202, " \n\t ", "en", None), (None, base[3], "en", "s1"), (None, None, None, None)]
    out += [(5, base[5], "fr", "s2"), (5, base[5], "fr", "s2")]  # repeated rows
    out += [(300, "word " * 30_000, "en", "s1"), (301, " ".join(f"x{k}" for k in range(20_000)), "de", "s3"), (302, "x" * 50_000, "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    made = [(*r, 1, "a", "b", "c", "d", "e", "f") for r in rows()]
    return spark.createDataFrame(made, FORM).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def same(a, b):
    return Counter(map(tuple, a)) == Counter(map(tuple, b))


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_components_of_awkward_graphs(spark):
    e = [(1, 2), (2, 3), (3, 1), (10, 9), (9, 8), (8, 7), (7, 6), (5, 5)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(e, "u long, v long")).collect()}
    want = {2: 1, 3: 1, 7: 6, 8: 6, 9: 6, 10: 6, **{k: 100 for k in range(101, 160)}, **{k: 200 for k in range(201, 241)}}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_by_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    all_rows = rows()
    fps = np.array([simhash.fingerprint((t or "").encode()) for _, t, _, _ in all_rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    lab = np.arange(len(fps))
    for _ in range(len(fps)):
        lab = np.array([lab[near[k]].min() for k in range(len(fps))])
    least = {}
    for k, (i, *_) in enumerate(all_rows):
        if i is not None:
            least[lab[k]] = min(i, least.get(lab[k], i))
    want = [(i, f"{int(fps[k]):016x}", least.get(lab[k])) for k, (i, *_) in enumerate(all_rows)]
    assert same(got, want)
    assert simhash.near_duplicates(empty).count() == 0


def test_hot_nodes_are_searched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)))
    edges = simhash.link_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 4)
    assert {r["v"] for r in graph.components(edges).collect()} == {int(fps.view(np.int64).min())}
    assert graph.components(edges).count() == len(fps) - 1


def test_keep_one_keeps_one_row_of_each_group(docs, empty):
    assert simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs)  # which has a column row of its own
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs.withColumn("n", F.monotonically_increasing_id()), "n").select("component_id").distinct().count()


def test_contamination_by_brute_force(spark, docs, empty):
    all_rows = rows()
    passage = " ".join(all_rows[7][1].split()[2:14])
    items = [(1, passage), (2, passage), (3, "w1"), (4, None), (5, "!!!"), (6, "absent words " * 9), (None, all_rows[8][1]), (7, " ".join(t for _, t, _, _ in all_rows[11:13]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    tidy = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for block in (1 << 20, 7):
        got = decontaminate.contamination(docs, bench, 10, block).collect()
        want = []
        for i, t, _, _ in all_rows:
            w, hit, names, best = tidy(t), set(), set(), (0, None, None)
            for name, text in items:
                own = tidy(text)
                m = min(10, len(own))
                heads = defaultdict(list)
                for k in range(len(own) - m + 1 if own else 0):
                    heads[tuple(own[k:k + m])].append(k)
                for p in range(len(w) - m + 1) if heads else ():
                    for k in heads.get(tuple(w[p:p + m]), ()):
                        hit.update(range(p, p + m))
                        names.add("" if name is None else str(name))
                        n = m
                        while p + n < len(w) and k + n < len(own) and w[p + n] == own[k + n]:
                            n += 1
                        if best[0] == 0 or (-n, p, "" if name is None else str(name)) < (-best[0], *best[1:]):
                            best = (n, p, "" if name is None else str(name))
            want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), *best))
        assert same(got, want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_packing_is_whole_and_gapless(docs, empty):
    got = packing.pack(docs, PATH).collect()
    own = bpe.Encoder(PATH)
    want = []
    for i, t, _, _ in rows():
        ids = np.append(own.whole.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert same([r[:5] for r in map(tuple, got)], want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) * 1.05 + 1
    assert packing.pack(empty, PATH).count() == 0


def test_shards_are_exact_and_uniform(spark, docs, empty):
    got = sharding.shard_documents(docs, 7).collect()
    assert same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows()])
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    many = spark.range(3000).repartition(5)
    out = sharding.uniform_shards(many, 3, block_rows=100).collect()
    by = np.zeros((3, 3))
    for r in out:
        by[r["shard"], min(2, r["id"] // 1000)] += 1
    assert (by.sum(axis=1) == 1000).all() and abs(by - 1000 / 3).max() < 75
    assert same(out, sharding.uniform_shards(many, 3, block_rows=100).collect())
    assert abs(np.corrcoef([r["id"] for r in out], [r["slot"] for r in out])[0, 1]) < 0.06
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.uniform_shards(docs, 2).columns.count("shard") == 1


def test_token_counts_add_up(docs, empty):
    own = bpe.Encoder(PATH)
    got = attribution.line_counts(docs, PATH).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    want = Counter()
    for i, t, _, _ in rows():
        want[i] += len(own.whole.encode(t or "", add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n"] for r in got} == dict(want)
    assert attribution.line_counts(empty, PATH).count() == 0 and attribution.field_counts(empty, ["source", "text"], PATH).count() == 0
    fields = attribution.field_counts(docs, ["source", "text", "lang"], PATH).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    whole = Counter()
    for i, t, lang, source in rows():
        whole[i] += len(own.whole.encode("\n".join(x or "" for x in (source, t, lang)), add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n"] for r in fields} == dict(whole)


def test_language_model_counts_and_base(docs, empty):
    got = lm.score(docs, head=50)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    toks = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, words_of(t) + ["\n"]) for i, t, _, _ in rows()]
    c = Counter(w for _, held, ws in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    den = math.log10(n + .1 * (v + 1))
    want = [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10(c[w] + .1) - den for w in ws), 6)) for i, held, ws in toks]
    out = got.collect()
    assert same([(*tuple(r)[:5], round(r["base_score"], 6)) for r in out], want)
    assert all(r["score"] < 0 for r in out)
    assert same([(*tuple(r)[:5], round(r["base_score"], 6)) for r in lm.score(docs).collect()], want)
    assert lm.score(empty).count() == 0


def test_language_model_gains_on_held_out_texts_whatever_the_partitions(spark, monkeypatch):
    """Words that follow each other in pairs: the model has to learn them. Partitions and copies do not change a score."""
    rng = np.random.default_rng(11)
    pairs = [f"a{k} b{k}" for k in range(60)]
    made = [(k, " ".join(rng.choice(pairs, 40)), "en") for k in range(1500)]
    d = spark.createDataFrame(made, "doc_id long, text string, row string")
    one = {r["doc_id"]: r for r in lm.score(d.repartition(1)).collect()}
    many = {r["doc_id"]: r for r in lm.score(d.repartition(7)).collect()}
    held = [r for r in one.values() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / n > 0.3
    assert all(abs(one[k]["score"] - many[k]["score"]) < 1e-3 for k in one)  # sums of 32-bit numbers
    copies = spark.createDataFrame([(k, made[0][1]) for k in range(3000, 3400)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(lm, "train", lambda texts, voc, known: (seen.append([r["key"] for r in texts.select("key").collect()]), voc.weights())[1])
    lm.score(copies)
    assert len(set(seen[0])) == len(seen[0]) > 300


def test_toxicity_learns_and_keeps_rows(spark, docs, empty):
    rng = np.random.default_rng(3)
    made = [(k, " ".join(rng.choice([f"w{j}" for j in range(200)], 40)) + (" vile" if k % 5 == 0 else ""), "en", "s") for k in range(700)]
    d = spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f") for r in made], FORM)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0), "x") for k in range(700)] + [(None, 1, 1, "x"), (3, 1, None, "x"), (4, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.95
    kept = toxicity.keep_civil(d, labels)
    assert kept.columns == d.columns and kept.where("doc_id % 5 = 0").count() < 15 and kept.where("doc_id % 5 != 0").count() > 545
    none = labels.limit(0)
    assert same([(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, none).collect()], [(i, 0) for i, *_ in rows()])
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_thresholds_count_every_labelled_row(spark, monkeypatch):
    """Of any length and beyond the sample, but not the held-out fold; the sample's rows alone gave no threshold to 'fr'."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(200)], 30 if k % 7 else 300)) + (" vile" if k % 4 == 0 else "") for k in range(500)]
    d = spark.createDataFrame([(k, t, "fr" if k % 2 == 0 else "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(500)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    seen = []
    keep = toxicity.set_thresholds
    monkeypatch.setattr(toxicity, "set_thresholds", lambda m, c: (seen.append(c := list(c)), keep(m, c)))
    model = toxicity.fit(d, labels)
    own = [k for k in range(500) if zlib.crc32(str(k).encode()) % 4 != 2]
    got = Counter()
    for lang, toxic, _, n in seen[-1]:
        got[lang, toxic] += n
    assert got == Counter(("fr" if k % 2 == 0 else "en", int(k % 4 == 0)) for k in own)
    assert "fr" in model.thresholds


def test_toxicity_trains_on_texts_of_any_length(spark, monkeypatch):
    """Texts are taken in hash order while they fit in; the long ones are toxic here, and none is left out for its length."""
    seen = []
    keep = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, *a: (seen.append(sorted(map(len, texts))), keep(texts, *a))[1])
    d = spark.createDataFrame([(k, " ".join(["calm"] * (4000 if k % 5 == 0 else 20))) for k in range(60)] + [(3, "calm " * 20), (61, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(62)], "doc_id long, toxic int")
    toxicity.fit(d, labels)
    assert seen[-1].count(4000) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(0, 60, 5))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5 * 20_000)
    toxicity.fit(d, labels)
    assert 4 <= seen[-1].count(4000) <= 5


def test_filters_keep_clean_rows_of_null_languages(spark, docs):
    """Null languages and sources are groups of their own; null texts fail the base rule and are no words to a score."""
    rng = np.random.default_rng(12)
    text = lambda bad: " ".join(rng.choice([f"w{k}" for k in range(150)], 60)).capitalize() + (" vile vile." if bad else ".")
    made = [(k, text(k % 6 == 0), None if k % 2 else "en", None if k % 3 else "s") for k in range(600)] + [(700, None, None, None), (701, "", None, "s")]
    d = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(500)], "doc_id long, toxic int")
    civil = {r["doc_id"] for r in toxicity.keep_civil(d, labels).collect()}
    assert {700, 701} <= civil and sum(k % 6 == 0 for k in civil if k < 600) < 10 and sum(k % 6 > 0 for k in civil if k < 600) > 490
    good = quality.keep_good(d)
    assert good.columns == d.columns and (kept := {r["doc_id"] for r in good.collect()}) <= set(range(600)) and len(kept) > 590
    assert toxicity.keep_civil(d.limit(0), labels).count() == 0


def test_quality_by_plain_numpy(spark, docs, empty, monkeypatch):
    got = {(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect()}
    want = {(*quality.counts((t or "").encode())[:5], quality.base_failed(*(quality.counts((t or "").encode())[k] for k in (0, 4)))) for _, t, _, _ in rows()}
    assert got == want and quality.judge(docs).count() == len(rows())
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice([f"word{k}" for k in range(400)], rng.integers(15, 200))).capitalize() + "." for _ in range(500)]
    junk = [" ".join(w + "%%%###"[rng.integers(0, 3):] for w in t.split()) for t in clean[:40]] + [t.upper().replace(" ", "!! ") for t in clean[40:70]]
    d = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert all(out[k]["kept"] for k in range(500)) and not any(out[k]["kept"] for k in range(500, 570))
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(range(500))
    # the estimate itself and the verdict, by plain numpy; one group: language and corpus are drawn to themselves
    raw = [quality.counts(t.encode()) for t in clean + junk]
    x, shares = np.array([r[5] for r in raw]), np.array([quality.vector(r[0], r[6], r[5])[7:] for r in raw])
    mean, cov = plain_mcd(x, shares)
    d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    mine = np.array([out[k]["distance2"] for k in range(len(x))])
    assert np.abs(np.log((mine + 1) / (d2 + 1))).max() < 0.1
    assert [out[k]["kept"] for k in range(len(x))] == [not out[k]["base_failed"] and mine[k] <= quality.chi2_quantile(0.99, 7) for k in range(len(x))]


def plain_mcd(x, shares):
    """Concentration steps from medians and absolute deviations and from sign correlations, then reweighting."""
    p = x.shape[1]

    def fit(at, share):
        noise = np.array([c * shares[at].mean(axis=0)[int(of == "lines")] for c, of in quality.NOISE])
        c = np.cov(x[at].T, bias=True) * quality.consistency(share, p)
        return x[at].mean(axis=0), c + np.diag(np.maximum(noise - np.diag(c), 0))

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    mid = np.median(x, axis=0)
    dev = 1.4826 * np.median(abs(x - mid), axis=0)
    m, c = mid, np.diag(dev**2 + 1e-3)
    for _ in range(quality.STEPS):
        core = np.argsort(distance(m, c))[:int(quality.CORE * len(x)) + 1]
        m, c = fit(core, len(core) / len(x))
    for _ in range(quality.REWEIGHTS):
        m, c = fit(np.flatnonzero(distance(m, c) <= quality.chi2_quantile(quality.WITHIN, p)), quality.WITHIN)
    return m, c


def test_robust_estimate_rejects_its_share_of_gaussian_data(spark):
    """With a fifth of outliers, about one in a hundred of the rest is beyond the 99 % quantile, and scales are the data's."""
    rng = np.random.default_rng(7)
    root = rng.normal(size=(7, 7)) * np.array([1, 2, 0.5, 3, 1, 1, 0.2])
    good = rng.normal(size=(4000, 7)) @ root + 5
    bad = rng.normal(size=(1000, 7)) * 0.3 + 60
    x = np.concatenate([good, bad])
    rows = spark.createDataFrame([(["g"], [*map(float, v), 1e-9, 1e-9]) for v in x], "keys array<string>, x array<double>")
    m = quality.mcd_models(rows).first()
    mean, cov = np.array(m["mean"]), np.array(m["cov"]).reshape(7, 7)
    d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    out = d2 > quality.chi2_quantile(0.99, 7)
    assert out[4000:].all() and 0.005 < out[:4000].mean() < 0.015 and abs(np.median(d2[:4000]) - 6.35) < 0.4
    assert np.abs(np.sqrt(np.diag(cov)) / np.sqrt(np.diag(root.T @ root)) - 1).max() < 0.06


def test_groups_are_drawn_to_their_wholes_without_a_step():
    mean, cov = np.ones(2), np.eye(2)
    near, far = np.zeros(2), 4 * np.eye(2)
    pulled = [quality.shrunk(n, mean, cov, (near, far))[0][0] for n in (*range(400), 10**6)]
    assert all(0 < b - a < 0.01 for a, b in zip(pulled, pulled[1:400]))
    assert quality.shrunk(0, mean, cov, (near, far))[1].tolist() == far.tolist() and abs(pulled[-1] - 1) < 1e-3


def test_urls_by_rule_and_by_tree(spark):
    urls = ["http://A.Example.com/en/7?x", "https://a.example.com/en/81#t", "http://x.net/de/1", "ftp://example.net/de/8/2", "http://b.org/es/", None, "", "no scheme", "http://", "http://h", "http://h?q", "http://h.it/a//b/"]
    p = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)] + [(0, urls[0], "h", 1), (None, "http://q.it/z", "h", 1)], "page_id long, url string, host string, verdict int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(p, labels).collect()}
    assert got == {
        (0, "a.example.com", "/en/7", "example.com/en/7", "allow"), (1, "a.example.com", "/en/81", "com/en/", "block"), (2, "x.net", "/de/1", "net/de/", "allow"), (3, "example.net", "/de/8/2", "example.net/de/8", "block"),
        (4, "b.org", "/es/", "org/es/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "h", "", None, "allow"), (10, "h", "", None, "allow"),
        (11, "h.it", "/a//b/", None, "allow"), (None, "q.it", "/z", None, "allow")}
    bad = [(k, f"http://site.it/{'spam' if k % 2 else 'news'}/{k}") for k in range(800)]
    p = spark.createDataFrame(bad, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if k % 2 else 1, 0) for k in range(800)], "doc_id long, quality int, toxic int")
    got = urlfilter.judge_urls(p, labels).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got) and {r["template"] for r in got} == {"//spam/#", "//news/#"}
    wide = spark.createDataFrame([(k, f"http://site.it/{chr(97 + k % 26)}{chr(97 + k // 26)}x/y") for k in range(300)], "page_id long, url string")
    assert {r["template"] for r in urlfilter.judge_urls(wide, labels.limit(0)).collect()} == {"/*/*/*"}
    assert urlfilter.judge_urls(p.limit(0), labels).count() == 0


def test_one_bad_branch_among_hundreds_is_blocked(spark):
    """At any fan: thin segments are one wildcard, whatever their few labels say; a well-labelled bad one stands out."""
    made = [(k, f"http://s.it/a{chr(97 + k % 20)}{chr(97 + k // 20 % 10)}/{k}", 1) for k in range(4000)]  # 200 good sections
    made += [(5000 + k, f"http://s.it/bad/{k}", 0) for k in range(60)]
    made += [(6000 + k, f"http://s.it/t{chr(97 + k % 26)}{chr(97 + k // 26)}/x", int(k % 10 > 0)) for k in range(500)]  # one label each
    p = spark.createDataFrame([r[:2] for r in made], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(p, labels).collect()}
    assert {k for k, r in got.items() if r["verdict"] == "block"} == set(range(5000, 5060))
    assert got[5000]["template"] == "//bad/#" and got[6001]["template"] == "//*/x"


def test_branches_with_different_subtrees_stay_apart(spark):
    """a/x and b/y are bad, a/y and b/x good, three levels down: a and b have one purity and must not be merged."""
    made = [(k, f"http://s.it/{'ab'[k % 2]}/m/{'xy'[k // 2 % 2]}/{k}", int((k % 2) != (k // 2 % 2))) for k in range(800)]
    p = spark.createDataFrame([r[:2] for r in made], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made], "doc_id long, quality int, toxic int")
    got = urlfilter.judge_urls(p, labels).collect()
    assert all((r["verdict"] == "allow") == bool(made[r["page_id"]][2]) for r in got)
    same_kind = [(k, f"http://s.it/{'abcd'[k % 4]}/{k}", int(k % 4 > 1)) for k in range(800)]
    p = spark.createDataFrame([r[:2] for r in same_kind], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in same_kind], "doc_id long, quality int, toxic int")
    assert {(r["template"], r["verdict"]) for r in urlfilter.judge_urls(p, labels).collect()} == {("//a+1/#", "block"), ("//c+1/#", "allow")}


def test_html_consensus(spark):
    page = lambda k, body: f"<html><body><div class='top'>Site menu</div><div class='box{k}'><p>{body}</p></div><div class='foot'>{'legal words ' * 3}</div></body></html>"
    rows = [(k, f"http://h.it/{k}", page(k, f"Some article text, number {k}, that is long enough to win. " * 4)) for k in range(20)]
    rows += [(50, "http://h.it/s", page(9, "Short.")), (51, None, "<p>Alone.</p>"), (52, "http://n.it", None), (53, "http://n.it", ""), (0, "http://h.it/0", rows[0][2])]
    p = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, path int")
    got = htmlextract.main_text(p)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert by[50]["text"] == "Short." and by[51]["text"] == "Alone." and by[52]["text"] == by[53]["text"] == "" and by[3]["path"] == "/html/body/div.box#" and by[3]["consensus"]
    assert all(r["n_chars"] == len(r["text"]) for r in by.values())
    assert htmlextract.main_text(p.limit(0)).count() == 0


def generated_pages(rng, hosts=12, each=6):
    """Hosts with layouts of their own; each page with the text that a reader would call its article."""
    words = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    wraps = ['<article class="a{k}">', '<main>', '<div class="post-content p{k}">', '<div id="story">', '<section class="box{k}">', '<td width="70%">', '<div class="has-sidebar c{k}"><div class="inner">']
    tops = ['<header><a href="/">Site {s}</a></header>', '<div class="header">SITE HEADER {s}</div>', '<div class="site-header top">Name {s}</div>', '<nav><a href=a>{s}</a></nav>', '<div class="topbar">{s}</div>']
    sides = ['<aside>{s}</aside>', '<div class="sidebar">{s}</div>', '<div class="related-posts">{s}</div>', '<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>', '<div id="cookie-notice">{s}</div>',
             '<div class="ad-slot">{s}</div>', '<form><label>{s}</label><input></form>', '<section id="comments"><div class="comment">{s} {s}</div></section>', '<div class="social share"><a href=x>{s}</a></div>']
    feet = ['<footer>{s}</footer>', '<div class="footer">{s}</div>', '<div id="newsletter">{s}</div>']
    fill = lambda t: t.format(s=say(6), k=rng.integers(0, 99))
    out = []
    for h in range(hosts):
        wrap = wraps[h % len(wraps)]
        top, side, foot = rng.choice(tops, 2, replace=False), rng.choice(sides, 3, replace=False), rng.choice(feet, 1)
        for k in range(each):
            blocks, html = [], []
            for b in range(rng.integers(3, 7)):
                text = say(rng.integers(8, 40))
                blocks.append(text)
                html.append({0: "<p>{}</p>", 1: "<p>{}", 2: '<div class="related-work">{}</div>', 3: "<h2>{}</h2>", 4: '<div class="entry-header">{}</div>'}[int(rng.integers(0, 5))].format(text.replace(" ", " \n ", 1)))
                if rng.random() < 0.3:
                    html.append(fill('<div class="advert">{s}</div>'))
            links = [say(2) for _ in range(3)]
            blocks.append(" and ".join(links))
            html.append("<p>" + " and ".join(f"<a href=x>{x}</a>" for x in links) + "</p>")
            opening = fill(wrap)
            closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
            if opening.startswith("<td"):
                opening, closing = "<table><tr>" + opening, closing + "</tr></table>"
            before, after = "".join(map(fill, top)), "".join(map(fill, [*side, *foot]))
            out.append((h * 100 + k, f"http://h{h}.it/{k}", f"<html><head><title>t</title></head><body>{before}{opening}{''.join(html)}{closing}{after}</body></html>", "\n\n".join(blocks)))
    return out


def test_html_of_hosts_with_layouts_of_their_own(spark):
    made = generated_pages(np.random.default_rng(21))
    p = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmlextract.main_text(p).collect()}
    wrong = [(i, html, got[i], want) for i, _, html, want in made if got[i] != want]
    assert not wrong, (len(wrong), wrong[0])


def test_shared_folder_is_the_sessions():
    class Session:
        conf = {"spark.checkpoint.dir": "file:///shared/here/"}

    assert common.shared_dir(Session) == "file:///shared/here"

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)


def test_hot_keys_stay_where_they_are(spark):
    rows = [(7, k) for k in range(3000)] + [(k, k) for k in range(100, 2100)]
    named = [(7, 3000, "a")] + [(k, 1, "b") for k in range(100, 2100)]
    left, right = spark.createDataFrame(rows, "key long, id long"), spark.createDataFrame(named, "key long, n long, name string")
    got = common.spread_join(left, right, "key", 5000)
    assert got.columns == ["key", "id", "name"] and same(got.collect(), [(k, i, "a" if k == 7 else "b") for k, i in rows])
    assert common.spread_join(left.limit(0), right.limit(0), "key", 0).count() == 0


def test_pipeline_stages_keep_columns_and_rows_that_are_clean(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(rng.choice([f"word{k}" for k in range(3000)], 60)).capitalize() + "."
    base = [text() for _ in range(260)]
    junk = ["%%% ### " * 40, "same words again and " * 30]
    item = " ".join(base[20].split()[5:25])
    made = [(k, t, "en", "s", len(t)) for k, t in enumerate(base + junk + [base[7], base[7].replace(" ", "\n", 3)])] + [(900, None, None, None, None), (900, "", "en", "s", 0)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality-rules", "toxicity", "near-duplicates", "decontamination", "pattern-packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        d = common.cut(out, "test")
    kept = {r["doc_id"] for r in d.collect()}
    assert kept == set(range(260)) - {20}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
