"""The parts of the operators that need no session, against plain versions of themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clausegrid.llm import attribution, bpe, decontaminate, htmlextract, lm, packing, quality, sharding, simhash, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXT = st.text(alphabet="abcXYZ éß#|.,'0 \n\t!😀", max_size=60)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcDE're \n\t .,!?#0123éñ'😀中 \x85<|", max_size=40))
def test_ids_and_spans_are_the_librarys(text):
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = own.whole.encode(text, add_special_tokens=False)
    assert own.ids(text).tolist() == want.ids
    a, b = own.spans(text)
    assert list(zip(a.tolist(), b.tolist())) == want.offsets


def test_special_token_text_goes_to_the_library(encoder):
    text = "a <|endoftext|> b"
    assert encoder.fast is not None
    assert encoder.ids(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_fingerprint_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want


def test_fingerprint_of_a_very_long_text_is_the_same_in_steps():
    words = [f"w{k % 977}" for k in range(70_000)]
    text = " ".join(words).encode()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[k:k + 4]), seed=42) for k in range(len(words) - 3)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(text) == want


def brute_groups(fps, d):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= d
    lab = np.arange(len(fps))
    while True:
        new = np.array([lab[near[k]].min() for k in range(len(fps))])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("n,spread", [(1, 0), (40, 3), (500, 3), (900, 8), (700, 64)])
def test_gray_index_finds_every_group(n, spread):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, size=max(1, n // 60), dtype=np.uint64)
    fps = centres[rng.integers(0, len(centres), n)]
    for _ in range(spread):
        fps = fps ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    fps = fps[np.argsort(simhash.gray_rank(fps), kind="stable")]
    assert (simhash.link_group(fps, 4) == brute_groups(fps, 4)).all()


def test_gray_rank_orders_by_one_bit_steps():
    x = np.arange(256, dtype=np.uint64)
    codes = x[np.argsort(simhash.gray_rank(x))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(codes.tolist(), codes.tolist()[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab cd ef".split()), max_size=30))
def test_repeated_words_both_ways(words):
    raw = [w.encode() for w in words]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(grams)
    want = len({p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 5)})
    assert quality.repeated_words(raw) == want
    if len(raw) > 5:
        assert quality._repeated_long(raw, 5) == want


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_base_counts_by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = quality.counts(text.encode())
    assert got[:4] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
    assert len(got[5]) == len(quality.STATISTICS) and all(np.isfinite(got[5]))


def test_chi2_quantile():
    assert abs(quality.chi2_quantile(0.99, 7) - 18.475) < 0.05
    assert abs(quality.chi2_quantile(0.5, 7) - 6.346) < 0.05
    assert abs(quality.chi2_share(18.475, 7) - 0.99) < 0.001 and abs(quality.consistency(0.5, 7) - 1 / 0.6036) < 0.05 and quality.consistency(1.0, 7) == 1


def brute_hits(docs, items, window):
    """(hit words, items, longest match as (words, place, item)) of each document, by the definition."""
    out = []
    for d in docs:
        hit, names, best = set(), set(), None
        for name, own in items:
            m = min(window, len(own))
            for k in range(len(own) - m + 1 if own else 0):
                for p in range(len(d) - m + 1):
                    if d[p:p + m] == own[k:k + m]:
                        hit.update(range(p, p + m))
                        names.add(name)
                        n = m
                        while p + n < len(d) and k + n < len(own) and d[p + n] == own[k + n]:
                            n += 1
                        best = min(best or (0,), (-n, p, name))
        out.append((len(hit), names, best and (-best[0], *best[1:])))
    return out


def shown(found):
    return [(int(h.sum()), n, best) for h, n, best in zip(*found)]


@pytest.mark.parametrize("window", [2, 4, 10])
@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_suffix_arrays_find_every_window_and_longest_match(window, blocks, pairs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rnd = random.Random(window)
    words = [f"w{k}".encode() for k in range(4)]
    docs = [[rnd.choice(words) for _ in range(rnd.randint(0, 60))] for _ in range(30)]
    items = [(f"i{k}", [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8, 14]))]) for k in range(9)]
    items += [("copy", items[3][1]), ("cut", docs[4][3:20] or [b"w0"]), ("long", docs[7][2:31]), ("same", [b"w1"] * 25)]
    docs += [[b"w1"] * 40, docs[7][5:] + docs[4]]
    made = [decontaminate.make_block(items[k::blocks], window) for k in range(blocks)]
    assert shown(decontaminate.search_shard(docs, made, longest=True)) == brute_hits(docs, items, window)
    assert decontaminate.search_shard(docs, made)[2] == [None] * len(docs)


def test_a_match_goes_on_through_the_pieces_of_an_item():
    rnd = random.Random(3)
    own = [f"w{rnd.randint(0, 5)}".encode() for _ in range(90)]
    pieces = [("i", own[k:k + 20], k) for k in range(0, 81, 11)]
    docs = [own, own[4:70], [b"x", *own[15:60], b"y"], own[30:45], own[::-1], []]
    for blocks in ([pieces], [[p] for p in pieces]):
        made = [decontaminate.make_block(b, 10) for b in blocks]
        assert shown(decontaminate.search_shard(docs, made, longest=True)) == brute_hits(docs, [("i", own)], 10)


def test_a_short_item_leaves_the_array_sparse():
    block = decontaminate.make_block([("one", [b"a"]), ("long", b"a b c d e f g h i j k".split())], 10)
    ids = np.array([2, 2, 1, 2, 3, 3, 1, 0], dtype=np.int32)  # b b a b c c a, then a word of no item
    assert sorted(decontaminate.suffix_array(ids, block)[0].tolist()) == [2, 6]


def test_words_of_decontamination():
    assert decontaminate.words("Ab-c É9_x\x7fy".encode()) == ["ab".encode(), b"c", "É9".encode(), b"x", b"y"]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    limit = [16, 64, 300][seed % 3]
    have = np.zeros(limit + 1, dtype=np.int64)
    have[1:] = rng.integers(0, 9, limit) * (rng.random(limit) < 0.6)
    have[limit] += 3
    made = packing.plan(have, limit)
    used = np.zeros_like(have)
    for own, n in made:
        assert sum(own) <= limit and n > 0
        for v in own:
            used[v] += n
    assert (used == have).all()
    plain = sum(n for _, n in packing.pack_residual(have.copy(), limit))
    assert sum(n for _, n in made) <= plain * 1.05 + 1


def test_plan_of_nothing_and_of_one_length():
    assert packing.plan(np.zeros(65, dtype=np.int64), 64) == []
    have = np.zeros(65, dtype=np.int64)
    have[20] = 10
    assert sum(n for _, n in packing.plan(have, 64)) == 4


def test_hypergeometric_matrix_has_exact_margins():
    parts, sizes = np.array([0, 5, 5, 17, 40, 41]), np.array([11, 10, 10, 10])
    rows = np.array([sharding.matrix_row(parts, sizes, p, 3) for p in range(5)])
    assert (rows.sum(axis=1) == np.diff(parts)).all() and (rows.sum(axis=0) == sizes).all()


def test_large_population_draws_are_hypergeometric():
    rng = np.random.default_rng(5)
    draws = np.array([sharding._draw_large(rng, 700, 300, 100) for _ in range(4000)])
    assert abs(draws.mean() - 70) < 0.4 and abs(draws.var() - 100 * .7 * .3 * 900 / 999) < 2
    big = sharding.draw_counts(rng, np.array([3 * 10**9, 2 * 10**9], dtype=np.int64), 10**9)
    assert big.sum() == 10**9 and abs(big[0] / 6e8 - 1) < 1e-3


def test_block_sizes_are_exact_and_bounded():
    shard, first, rows = sharding.block_sizes(1003, 4, 100)
    assert [rows[shard == s].sum() for s in range(4)] == [251, 251, 251, 250] and rows.max() <= 100
    assert all(first[k + 1] == first[k] + rows[k] for k in range(len(rows) - 1) if shard[k] == shard[k + 1])


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_every_token_is_counted_once(text):
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    starts, ends = attribution.lines(text)
    a, b = own.spans(text)
    part, crosses = attribution.allocate(starts, ends, a, b)
    for k in range(len(a)):
        touched = [p for p in range(len(starts)) if ends[p] > starts[p] and a[k] < ends[p] and starts[p] < b[k]]
        assert part[k] == (touched[0] if touched else -1)
        assert crosses[k] == bool(touched and (a[k] < starts[touched[0]] or b[k] > ends[touched[0]]))


HTML = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="menu"><a href=1>a</a> <a href=2>b</a><a href=3>c</a></div><div class="post-content"><h1>Title &amp; more</h1><p>First para one, two &lt;three&gt;.<p>Second <b>bo</b>ld.<ul><li>item 1<li>item 2</ul>
<div class=ad>BUY</div><form>Search</form><script>var x="<p>no</p>"</script><blockquote>Quote&nbsp;here</blockquote></div>
<section id="comments"><div class=comment><p>A reader comment that is much longer than the article itself, and on and on and on and on and on and on and on.</p></div></section><aside>side</aside></body><footer>foot</footer>"""


def test_html_keeps_the_article_alone():
    text, path, agreed = htmlextract.extract(HTML)
    assert text == "Title & more\n\nFirst para one, two <three>.\n\nSecond bold.\n\nitem 1\n\nitem 2\n\nQuote here" and not agreed
    assert htmlextract.extract(HTML, path) == (text, path, True)
    assert htmlextract.extract(HTML, "/html/none") == (text, path, False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-pdivab \"'=&;#x1\n", max_size=80))
def test_any_markup_is_read(html):
    text = htmlextract.extract(html)[0]
    assert text == "\n\n".join(" ".join(b.split()) for b in text.split("\n\n"))


def test_html_edges():
    assert htmlextract.extract(None)[0] == htmlextract.extract("")[0] == htmlextract.extract("<p></p>")[0] == ""
    assert htmlextract.extract("plain &copy text")[0] == "plain © text"
    assert htmlextract.extract("<div>" * 5000 + "deep")[0] == "deep"


def test_branches_merge_only_when_alike():
    assert urlfilter.merge_bins([1000, 1000, 1000, 3], [100, 900, 905, 3]) == [0, 1, 1, 1]
    assert urlfilter.merge_bins([], []) == [] and urlfilter.merge_bins([2, 2], [0, 2]) == [0, 0]


def test_threshold_is_the_best_on_held_out_labels():
    assert urlfilter.choose_threshold([]) == urlfilter.choose_threshold([(0.9, 10, 9), (0.7, 10, 6)]) == urlfilter.THRESHOLD
    assert urlfilter.choose_threshold([(0.66, 4, 0), (0.9, 100, 95)]) == 0.67
    assert urlfilter.choose_threshold([(0.2, 10, 1), (0.4, 10, 8), (0.9, 9, 9)]) == 0.4


def test_language_model_is_a_distribution():
    """The probabilities of all words after any context add up to one less the classes' shares of unknown words."""
    words = [f"w{k}".encode() for k in range(1500)] + [lm.END]
    counts = [max(1, 3000 // (k + 1)) for k in range(1500)] + [40]
    mass = {}
    for w, c in zip(words, counts):
        e = lm.ending_class(w)
        n, v = mass.get(e, (0, 0))
        mass[e] = (n + c, v + 1)
    voc = lm.Vocabulary(words, counts, mass, sum(counts), len(words))
    weights = voc.weights()
    rng = np.random.default_rng(1)
    for w in weights:
        w += rng.normal(0, 0.3, w.shape).astype(np.float32) * (w > -1000)
    before = [3, 77]
    total = 0.0
    n = len(voc.words)
    ids = np.array([x for k in range(n) for x in (*before, k)], dtype=np.int32)
    lp = lm.log10_model(weights, voc, ids, np.arange(0, len(ids), 3))[2::3]
    lp = lp + np.where(voc.slot[:n] < 0, voc.log_count, 0)
    total = (10 ** lp).sum()
    unknown = sum(10 ** (lm.log10_model(weights, voc, np.array([*before, n + e], dtype=np.int32), np.array([0]))[2] + np.log10(lm.SMOOTH)) for e in range(lm.ENDINGS))
    assert abs(total + unknown - 1) < 1e-4


def test_language_model_grows_with_the_vocabulary():
    """At no size fewer than 1024 weighted words, 16 endings and the skip to the third word; more of each row with more words."""
    small, large = (lm.Vocabulary([lm.END], [5], {lm.ending_class(lm.END): (5, 1)}, 5, n) for n in (1, 1 << 23))
    assert small.classes * small.slots >= 1024 and lm.ENDINGS >= 16
    assert large.classes * large.slots > 3 * small.classes * small.slots
    for a, b in zip(small.weights(), large.weights()):
        assert len(b) > 3 * len(a) and b.shape[1] > a.shape[1]
    assert max(w.size for w in lm.Vocabulary([lm.END], [5], {lm.ending_class(lm.END): (5, 1)}, 5, 1 << 50).weights()) < 1.1 * (1 << 25)
    ids = np.array([1, 2, 3, 0, 4, 2, 3, 0], dtype=np.int32)
    one, two = (np.array([r[k] for r in lm.class_rows(lm.contexts(ids, np.array([0, 4])), small.class_at)]) for k in (3, 7))
    assert (one[:3] == two[:3]).all() and one[3] != two[3]
    r = np.random.default_rng(3).integers(0, 1 << 20, 5000)
    assert (lm._order(r) == np.argsort(r, kind="stable")).all()


@pytest.mark.parametrize("width", [6, 7])
def test_language_model_sums_gradients_by_row(width):
    rng = np.random.default_rng(width)
    rows, grad = rng.integers(0, 40, 500) ** 2 // 30, rng.normal(size=(500, width)).astype(np.float32)
    table, seen = np.zeros((60, width), dtype=np.float32), np.zeros(60, dtype=np.float32)
    lm._climb(table, seen, [rows], grad)
    n = np.bincount(rows, minlength=60)
    want = np.stack([grad[rows == k].sum(axis=0) * lm.STEP / (n[k] + lm.DAMP) for k in range(60)])
    assert (seen == n).all() and np.abs(table - want).max() < 1e-5


def test_language_model_numbers_are_packed_and_back():
    for ids in (np.zeros(0, dtype=np.int32), np.array([0, 65535, 65536, (1 << 17) + 15, (1 << 24) - 1, 7], dtype=np.int32)):
        assert lm.unpacked(lm.packed(ids)).tolist() == ids.tolist() and lm.unpacked(lm.packed(ids)).dtype == np.int32


def test_language_model_contexts_by_slices():
    ids, first = np.arange(10, dtype=np.int32) + 5, np.array([0, 4, 5])
    whole = lm.contexts(ids, first)
    assert whole[0].tolist() == [0, 6, 7, 8, 0, 0, 11, 12, 13, 14] and whole[2].tolist() == [0, 0, 0, 6, 0, 0, 0, 0, 11, 12]
    for a, b in zip(whole, lm.contexts(ids, first, 3, 7)):
        assert (a[3:7] == b).all()


def test_toxicity_learns_a_planted_word():
    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice([f"w{k}" for k in range(400)], 60)) + (" vileword" if k % 4 == 0 else "")).encode() for k in range(600)]
    y = np.array([float(k % 4 == 0) for k in range(600)])
    hashed = [toxicity.word_hashes(t) for t in texts]
    model = toxicity.train(hashed[:400], y[:400], np.ones(400))
    toxicity.calibrate(model, model.logits(hashed[400:500]), y[400:500], np.ones(100), ["en"] * 100)
    s = model.scores(hashed[500:])
    assert ((s >= 0.3) == (y[500:] == 1)).mean() > 0.97
    assert 0 <= model.scores([toxicity.word_hashes(b"")])[0] <= 1


def test_toxicity_wide_filters_learn_an_order():
    """Two words that are toxic only side by side, in this order: both stand in every text, so no single word tells."""
    rng = np.random.default_rng(6)
    rest = [f"w{k}" for k in range(100)]

    def text(toxic):
        own = list(rng.choice(rest, 30))
        at = sorted(rng.choice(28, 2, replace=False))
        if toxic:
            own[at[0]:at[0]] = ["red", "blue"]
        else:
            own[at[1] + 1:at[1] + 1] = ["red"]
            own[at[0]:at[0]] = ["blue"]
        return " ".join(own).encode()

    y = np.array([float(k % 2) for k in range(3000)])
    hashed = [toxicity.word_hashes(text(v)) for v in y]
    model = toxicity.train(hashed[:2400], y[:2400], np.ones(2400))
    right = ((model.logits(hashed[2400:]) > 0) == (y[2400:] == 1)).mean()
    assert right > 0.9
