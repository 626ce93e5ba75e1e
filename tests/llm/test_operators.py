"""Operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import bradley_terry, gru_lm, license_scan, line_blocks, raking, rank_profiles
from quarrymill.llm.bradley_terry import keep_good, quality_classifier
from quarrymill.llm.cluster import join_groups
from quarrymill.llm.components import connected_components
from quarrymill.llm.decontamination import benchmark_matches, decontaminate
from quarrymill.llm.exact_dedup import exact_dedup
from quarrymill.llm.line_dedup import line_dedup, repeated_lines
from quarrymill.llm.ngram_join import _packed, _prefix, _size_code, _unpacked, ngram_jaccard_join, one_of_each

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, c int, kind string, word string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" + rng.choice(["", ".", ","]) for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies and edge cases; ids are not in order."""
    rng = random.Random(5)
    out = [None, "", " \n\t ", "one", "two words", "Two  WORDS", "É", "é", "a b c d e", "a b c d e f"]
    for _ in range(12):
        body = "\n".join(prose(rng, rng.randrange(6, 40)) for _ in range(rng.randrange(1, 6)))
        out += [body] * rng.randrange(1, 4) + ["\n".join(edited(rng, line, rng.choice([0, 0.02, 0.05, 0.1])) for line in body.split("\n")) for _ in range(rng.randrange(6))]
    out.append(prose(rng, 20_000, 3000))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns carry names that operators use inside."""
    return spark.createDataFrame([(i * 3, t, "en", "s", 1, "x", 1, "k", "w") for i, t in enumerate(texts)], DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, texts, empty, spark):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(FOLD), []).append(i * 3)
    for keep, best in (("max", max), ("min", min)):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs, keep=keep).collect()}
        assert got == {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert {tuple(r)[:4] for r in exact_dedup(twice).collect()} == {(1, 1, 3, True), (None, 1, 3, False)}


def brute_components(texts, ids, k=5):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def test_ngram_join(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs).collect()}
    assert got == brute_components(texts, [i * 3 for i in range(len(texts))])
    assert ngram_jaccard_join(empty).count() == 0


def test_ngram_join_in_blocks(spark, monkeypatch):
    """One group of near copies over many blocks."""
    monkeypatch.setattr("quarrymill.llm.ngram_join.BLOCK_SHINGLES", 300)
    rng = random.Random(8)
    base = prose(rng, 60)
    texts = [edited(rng, base, 0.03) for _ in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_components(texts, list(range(40)))


def test_ngram_join_candidates_do_not_chain(spark, monkeypatch):
    """Long unrelated texts share shingles by chance; they are not one candidate group, while near copies among them are found."""
    seen = []
    monkeypatch.setattr("quarrymill.llm.ngram_join.connected_components", lambda edges: seen.append(connected_components(edges)) or seen[-1])
    rng = random.Random(3)
    monkeypatch.setattr("quarrymill.llm.ngram_join.SKETCH_BITS", 4)  # as full as on a large corpus
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(1500)) for _ in range(60)]
    texts += [edited(rng, t, 0.01) for t in texts[:5]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_components(texts, list(range(len(texts))))
    assert max(r["count"] for r in seen[0].groupBy("label").count().collect()) <= 6


@pytest.mark.parametrize("threshold", [(3, 4), (4, 5), (9, 10), (1, 2)])
def test_prefix_meets_every_link(threshold):
    """Sets that link and differ share a token of their prefixes whose sizes allow the other, in any order of the shingles."""
    num, den = threshold
    rng = np.random.default_rng(4)
    for _ in range(4000):
        common = rng.integers(1, 30)
        apart = int(common * (den - num) // num)
        left = rng.integers(0, apart + 1)
        if not apart:
            continue
        every = rng.permutation(rng.integers(0, 1 << 63, common + apart, dtype=np.uint64))
        a, b = np.sort(every[: common + left]), np.sort(np.concatenate([every[:common], every[common + left :]]))
        rank = lambda s: (s >> np.uint64(60)).astype(np.uint32)
        (t, h), (u, g) = _prefix(a, rank(a), num, den), _prefix(b, rank(b), num, den)
        x, y = dict(zip(t.tolist(), h.tolist(), strict=True)), dict(zip(u.tolist(), g.tolist(), strict=True))
        assert any(x[k] >= len(b) and y[k] >= len(a) for k in x.keys() & y.keys())


def test_postings_pack_and_unpack():
    rng = np.random.default_rng(1)
    cols = rng.integers(0, 1 << 40, 500), rng.integers(0, 4096, 500), rng.integers(0, 4096, 500), rng.integers(0, 1 << 48, 500)
    assert all((a == b).all() for a, b in zip(cols, _unpacked(pa.py_buffer(_packed(*cols))), strict=True))
    sizes = np.arange(1, 1 << 16)
    assert (np.diff(_size_code(sizes).astype(int)) >= 0).all() and _size_code(np.array([2**31 - 1])).max() < 4096


def brute_lines(texts):
    seen, gone = [], set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").translate(FOLD).split("\n")):
            if len(line) < 30:
                continue
            s = {w for w in re.split(r"[\x09-\x0D ]+", line) if w}
            if any(4 * len(s & o) >= 3 * len(s | o) for o in seen if s or o):
                gone.add((i * 3, k))
            seen.append(s)
    return gone


def test_line_dedup(docs, texts, empty):
    want = brute_lines(texts)
    assert {(r["doc_id"], r["line_no"]) for r in repeated_lines(docs).collect()} == want
    out = line_dedup(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in enumerate(texts):
        lines = [x for k, x in enumerate((t or "").split("\n")) if (i * 3, k) not in want]
        assert kept[i * 3] == (t if t is None else "\n".join(lines))
    assert line_dedup(empty).count() == 0


def test_short_lines_take_part(spark, tmp_path):
    """Query and pipeline stage: short lines go when they repeat, exactly or nearly; blank ones stay."""
    import corpus_pipeline
    from quarrymill.llm.line_dedup import op8_line_dedup

    texts = ["All rights reserved.\n\nPage\nred green blue cyan", "all rights reserved.\n\n  \nred green blue\nPages", "  \nAll rights\nPage\n" + " " * 40, " " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {0: [], 1: [0, 3], 2: [2], 3: []}
    assert {r["doc_id"]: [int(x) for x in r["lines_removed"].split(",") if x] for r in op8_line_dedup(spark, str(tmp_path)).collect()} == gone
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)}


def test_decontamination(spark, docs, empty):
    item = "Tom Baker sells 12 boxes of apples, then 7 kg of pears, and asks how much Tom Baker has left after 12 days of trade."
    bench = spark.createDataFrame([(1, item), (2, "short item of five words"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, item)], "item_id long, text string")
    other = "Ann Miller sells 55 boxes of apples, then 9 lb of pears, and asks how much Ann Miller has left after 55 days of trade."
    rows = [
        (1, "Before it. " + item + " And after."), (2, "Well, " + other), (3, other.replace("after 55 days", "after 56 days")), (4, "x short item of five words y"),
        (5, None), (6, ""), (7, "A sells 3 boxes of something else entirely, with no pears at all in 9 days."), (8, "7 8 9 10 11 12 13 14 15 16 17 18 19"), (8, "again " + item),
    ]
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, h string, item_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_matches(d, bench).collect()}
    bad = {k for k, r in got.items() if r["contaminated"]}
    assert bad == {(1, 1), (2, 1), (4, 2), (8, 1)}
    assert not got[(3, 1)]["consistent"] and got[(2, 1)]["slots"] > 0
    assert sorted(r["doc_id"] for r in decontaminate(d, bench).collect()) == [3, 5, 6, 7]
    assert benchmark_matches(empty, bench).count() == 0 and benchmark_matches(docs, bench.limit(0)).count() == 0


def test_decontamination_at_every_alignment(spark):
    """A 17-token item whose 11th word is another leaves three windows of ten, wherever it stands in the document."""
    item = [f"term{chr(97 + i)}" for i in range(17)]
    other = " ".join([*item[:10], "changed", *item[11:]])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    d = spark.createDataFrame([(k, "pad " * k + other) for k in range(8)], "doc_id long, text string")
    got = benchmark_matches(d, bench).where("contaminated").collect()
    assert sorted((r["doc_id"], r["windows"], r["item_windows"]) for r in got) == [(k, 3, 10) for k in range(8)]


def test_decontamination_of_slots(spark):
    """Items of few plain tokens are found verbatim, and by their other windows where those can match."""
    bench = spark.createDataFrame([(1, "What is 12 times 7?"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "how many apples are left in the box if 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 go")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Say: what is 12 times 7? Quickly."), (2, "what is 13 times 7?"), (3, "a 1 2 3 4 5 6 7 8 9 10 11 12 b"), (4, "so how many apples are left in the box if 31 2 3 4 5 6 7 38 go"), (5, "0 2 4 6 8 10 12 14 16 18 20 22")], "doc_id long, text string")
    got = benchmark_matches(d, bench).where("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (4, 3)}


def test_license_scan(spark, empty):
    rng = random.Random(2)
    named = {t: text for t, _, text in license_scan.TEMPLATES}
    rows, want = [(900, None), (901, ""), (902, "MIT"), (903, "all rights are good")], set()
    for i, (name, text) in enumerate(named.items()):
        rows.append((i, prose(rng, rng.randrange(60)) + "\n" + text.upper() + " " + prose(rng, rng.randrange(60))))
    got = {(r["doc_id"], r["template"]): r["containment"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(named):
        assert got[(i, name)] == 1.0
    tokens = lambda t: [w for w in re.split(r"\s+", re.sub(r"[^\w\s.-]+|[.-]+(?!\w)|(?<!\w)[.-]+", " ", (t or "").translate(FOLD))) if w]
    sh = lambda t: {tuple(x[i : i + 3]) for x in [tokens(t)] for i in range(max(1, len(x) - 2))}
    want = {(i, n) for i, t in rows for n, text in named.items() if len(sh(text) & sh(t)) >= 0.8 * len(sh(text))}
    assert set(got) == want
    assert license_scan.license_scan(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(4)
    good = lambda: prose(rng, rng.randrange(20, 80)).capitalize()
    bad = lambda: "!! ".join(prose(rng, 5).upper().split()) * rng.randrange(2, 9)
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, "")]
    d = spark.createDataFrame([(i, t, 0.5, i % 2) for i, t in rows], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier(d, labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(300) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.95
    assert keep_good(d, labels).columns == d.columns
    assert {r["doc_id"] for r in keep_good(d, labels).collect()} == {i for i, r in got.items() if r["predicted"]}
    assert {r["score"] for r in quality_classifier(d, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier(empty, labels).count() == 0
    rejected = quality_classifier(d, labels, reject_quantile=0.25).where("predicted = 0").count()
    assert 0 < rejected <= 302 * 0.3


def test_preference_pairs_are_not_held_at_once():
    """Differences of pairs are laid out by blocks: the peak follows the rows, not the pairs; the weights stand at the minimum over all pairs."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, bradley_terry.N_FEATURES))
    label = (x[:, 0] + rng.standard_normal(4000) > 0).astype(int)
    tracemalloc.start()
    ranker = bradley_terry.fit(x, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * x.nbytes
    z = np.clip((x - ranker.mean) / ranker.scale, -6, 6)
    good, bad, again = np.flatnonzero(label == 1), np.flatnonzero(label == 0), np.random.default_rng(7)
    i = np.concatenate([np.repeat(good, 8), again.choice(good, len(bad) * 8)])
    j = np.concatenate([again.choice(bad, len(good) * 8), np.repeat(bad, 8)])
    diff = z[i] - z[j]
    grad = ranker.weights - diff.T @ (1 / (1 + np.exp(diff @ ranker.weights)))
    assert np.abs(grad).max() < 0.1


def test_language_id(spark, empty):
    rng = random.Random(6)
    alphabets = {"aa": "abcdeé", "bb": "xyzuvw", "cc": "абвгд"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate(sorted(alphabets) * 40)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !!", "bb"), (903, "xyz", None)]
    got = {r["doc_id"]: r for r in rank_profiles.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert rank_profiles.language_id(empty).count() == 0


def test_profiles_by_hand():
    seq, (a, e) = rank_profiles.letters(np.frombuffer(b"Ab, b", np.uint8), np.array([0, 5]))
    assert seq.tolist() == [0, 97, 98, 0, 98, 0] and (a[0], e[0]) == (0, 6)
    code, count = rank_profiles.grams(seq)
    # "b" twice by itself and once behind an edge, which is another gram
    edge = rank_profiles.EDGE
    assert count[code == 98].tolist() == [2] and count[code == (edge << 21) + 98].tolist() == [1]
    assert edge not in code and 0 not in code and len(set(code.tolist())) == len(code)
    both = rank_profiles.Profiles({"x": np.array([1, 2, 3]), "y": np.array([3, 2, 1])}, profile=3)
    assert both.langs == ["x", "y"] and both.rank[:, :3].tolist() == [[0, 1, 2], [2, 1, 0]]


def test_html():
    main = line_blocks.main_text
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>First<br>line<p>Second&nbsp; one</article><div id="comments"><p>rude</p></div><footer>&copy;</footer>'
    assert main(page) == "Head & more\n\nFirst line\n\nSecond one"
    plain = "<body><div class='cookie-notice'>We use cookies</div><p>" + "word " * 40 + "</p><p>short.</p><p>" + "more " * 30 + "</p><aside>side</aside><ul><li><a>link</a></li></ul>"
    assert main(plain) == ("word " * 40).strip() + "\n\nshort.\n\n" + ("more " * 30).strip()
    assert [main(x) for x in (None, "", "<", "<p", "<script>x", '<a href="x')] == [""] * 6
    assert main("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article>a<p>b", "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in line_blocks.html_extraction(pages).collect())
    assert got == [(1, "", 0), (1, "a\n\nb", 4), (2, "", 0)]
    assert line_blocks.html_extraction(pages.limit(0)).count() == 0


def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    index = [np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)]
    mass = rng.integers(1, 50, 24).astype(float)
    targets = [np.full(4, mass.sum() / 4), np.array([1, 2, 3, 4, 5, 6]) * mass.sum() / 21]
    w = mass * raking.rake(mass, index, targets)
    for at, want in zip(index, targets, strict=True):
        assert np.allclose(np.bincount(at, weights=w), want, rtol=1e-6)


def test_mixing(spark, empty):
    rows = [(i, prose(random.Random(i), 20), ["en", "de", None][i % 3], "big" if i % 4 else "small") for i in range(1200)] + [(5000, None, "en", None), (None, "", "en", "big")]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, weight double")
    got = raking.mix_to_targets(d, {"source": {"big": 0.5, "small": 0.5}}, 0.4).collect()
    assert len(got) == len(rows)
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in got) - 0.4 * total) < 1e-6 * total
    kept = [r for r in got if r["sampled"]]
    share = sum(r["n_tokens"] for r in kept if r["source"] == "small") / sum(r["n_tokens"] for r in kept)
    assert 0.42 < share < 0.58 and {r["doc_id"] for r in raking.sample_to_targets(d, {"source": {"big": 0.5, "small": 0.5}}, 0.4).collect()} == {r["doc_id"] for r in kept}
    assert raking.mix_to_targets(empty).count() == 0


def test_raking_as_steps_gives_the_same(spark):
    """Both paths after as many rounds: a sparse table, with capped cells, a null, a value without tokens and one without a share."""
    cells = [("a", "x", "p", 900), ("a", "y", "p", 40), ("b", "y", "p", 500), ("b", "x", "q", 40), ("c", "y", "q", 300), ("c", "x", "q", 90), ("d", "y", "q", 20), ("d", "x", "p", 9), (None, "x", "p", 9), (None, "y", "q", 70), ("e", "y", "q", 0)]
    d = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long").coalesce(1)
    targets = {"source": {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.1, None: 0.1, "none": 0.4}, "topic": {"p": 2, "q": 1}}
    here, spread = ({tuple(r)[:3]: (r["weight"], r["probability"]) for r in f(d, targets, 0.6, rounds=12).collect()} for f in (raking._factors_here, raking._factors_spread))
    assert set(here) == set(spread) and any(p == 1 for _, p in here.values()) and any(p < 1 for _, p in here.values())
    for k, v in here.items():
        assert np.allclose(v, spread[k], rtol=1e-8, atol=1e-12), (k, v, spread[k])


def test_gradients():
    """Backpropagation against finite differences of the loss."""
    net = gru_lm.Network(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(0, gru_lm.VOCABULARY + 5, 15).astype(np.int32)
    bounds, caught = np.array([0, 6, 15]), {}
    trainer = gru_lm.Trainer(net)
    trainer._update = lambda grads, scale: caught.update({k: g.copy() for k, g in grads.items()})
    loss = -trainer.fit(ids, bounds, 1, lanes=2) * len(ids)
    assert np.isclose(loss, -gru_lm.score_texts(net, ids, bounds, 1).sum() * np.log(10), rtol=1e-4)
    for name, at in (("u", (3, 40)), ("b", (5,)), ("wc", (2, int(ids[0]) // 64)), ("x", (int(ids[0]), 70)), ("bc", (7,))):
        for_each = []
        for e in (1e-3, -1e-3):
            net.p[name][at] += e
            for_each.append(-trainer.fit(ids, bounds, 1, lanes=2) * len(ids))
            net.p[name][at] -= e
        trainer.fit(ids, bounds, 1, lanes=2)
        assert abs((for_each[0] - for_each[1]) / 2e-3 - caught[name][at]) < 2e-2 * max(1, abs(caught[name][at])), name


def test_lm_scores(spark, empty):
    rng = random.Random(9)
    rows = [(i, " ".join(["alpha beta gamma delta", "eins zwei drei vier"][i % 2] for _ in range(rng.randrange(1, 30))) + f" u{i}") for i in range(200)] + [(900, None), (901, ""), (7, "eins"), (7, "eins")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = gru_lm.lm_scores(d).collect()
    tokens = [(i, [*words(t), None]) for i, t in rows]
    counts = {}
    for i, t in tokens:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(w in counts for w in t), n, round(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(r["score"] < 0 for r in got)
    assert gru_lm.lm_scores(empty).count() == 0


def test_network_learns_from_every_text(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 40), 50) for _ in range(300)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    none = np.zeros(0, np.int64)
    net = gru_lm._trained(d, gru_lm.Vocabulary(none, none, none, gru_lm.VOCABULARY), none, np.ones(gru_lm._SHAPES))
    assert net.seen == sum(len(words(t)) + 1 for t in texts)


def test_scores_do_not_hang_on_lanes():
    """Texts score alike whatever lanes and windows they fall into, also with large logits."""
    rng = np.random.default_rng(5)
    size = np.array([1, 900, 3, 40, 1, 77, 250, 2])
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, gru_lm.VOCABULARY + gru_lm._SHAPES, bounds[-1]).astype(np.int32)
    net = gru_lm.Network(seed=4)
    one_by_one = [gru_lm.score_texts(net, ids[a:b], np.array([0, b - a]), 1)[0] for a, b in itertools.pairwise(bounds)]
    for lanes in (1, 2, 5, 256):
        assert np.allclose(gru_lm.score_texts(net, ids, bounds, 1, lanes), one_by_one, rtol=1e-5)
    laid = gru_lm.Lanes.of(bounds, 3)
    assert sorted(laid.token) == list(range(bounds[-1])) and laid.live.sum() == bounds[-1] and (np.diff(laid.live) <= 0).all()
    net.p["bc"] += 200
    assert np.allclose(gru_lm.score_texts(net, ids, bounds, 1), one_by_one, rtol=1e-4)
    assert len(gru_lm.score_texts(net, ids[:0], np.zeros(1, np.int64), 1)) == 0


def test_probabilities_sum_to_one():
    net = gru_lm.Network()
    h = np.random.default_rng(2).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    n = gru_lm.VOCABULARY + gru_lm._SHAPES
    assert abs(np.exp(net.output(np.repeat(h, n, 0), np.arange(n))[0]).sum() - 1) < 1e-3


def test_shapes_are_told_apart_in_a_class_of_their_own():
    """The class softmax has one place for all tokens outside the vocabulary; gradients of shapes hold against finite differences."""
    net = gru_lm.Network(seed=6)
    assert net.p["wc"].shape == (gru_lm.HIDDEN, gru_lm.CLASSES + 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = np.random.default_rng(1).standard_normal((6, gru_lm.HIDDEN))
    target = np.array([gru_lm.VOCABULARY + 90, 0, gru_lm.VOCABULARY - 1, gru_lm.VOCABULARY, 70, gru_lm.VOCABULARY + 90])
    grads = {}
    dh = net.output(h, target, grads)[1]
    for name, at in (("ws", (4, 90)), ("bs", (3,)), ("bv", (1, 6)), ("bv", (63, 63)), ("wv", (0, 2, 0)), ("wc", (5, gru_lm.CLASSES))):
        net.p[name][at] += 1e-4
        up = net.output(h, target)[0].sum()
        net.p[name][at] -= 2e-4
        down = net.output(h, target)[0].sum()
        net.p[name][at] += 1e-4
        assert abs((down - up) / 2e-4 - grads[name][at]) < 1e-5, name
    up, down = (net.output(h + e * (np.arange(6) == 5)[:, None] * (np.arange(gru_lm.HIDDEN) == 7), target)[0].sum() for e in (1e-4, -1e-4))
    assert abs((down - up) / 2e-4 - dh[5, 7]) < 1e-5


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (50, 49)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 49: 49, 50: 49}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_group_joins_answer_hot_and_cold_keys_alike(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(500)], "id long, k long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    want = {tuple(r) for r in rows.join(groups, "k").select("id", "k", "n", "m").collect()}
    for total in (500, 15_000_000):  # the larger one makes groups of 150 rows and more the hot ones
        assert {tuple(r) for r in join_groups(rows, groups, "k", "n", total).select("id", "k", "n", "m").collect()} == want


def test_ngram_join_by_rows(spark):
    """Rows that repeat an id keep the links of each text, and links lead through rows without an id."""
    rng = random.Random(11)
    a, b = prose(rng, 40), prose(rng, 40)
    a2, b2 = a + " end", b + " end"
    out = ngram_jaccard_join(spark.createDataFrame([(1, a), (7, a2), (2, b), (7, b2)], "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in out) == [1, 1, 2, 2] and all(r["n_links"] == 1 for r in out)
    words_ = prose(rng, 40).split(" ")
    first, middle, last = (" ".join(words_[i : i + 34]) for i in (0, 2, 4))
    out = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame([(5, first), (None, middle), (9, last), (None, "x y")], "doc_id long, text string")).collect() if r["n_shingles"] > 1}
    assert out == {5: 5, None: 5, 9: 5}


def test_license_recall(spark):
    """Notices with words changed, in other text: all that exact containment accepts in a brute-force scan are found."""
    rng = random.Random(12)
    texts = {t: text for t, _, text in license_scan.TEMPLATES}
    rows, want = [], set()
    tokens = lambda t: [w for w in re.split(r"\s+", re.sub(r"[^\w\s.-]+|[.-]+(?!\w)|(?<!\w)[.-]+", " ", t.translate(FOLD))) if w]
    sh = lambda x: {tuple(x[i : i + 3]) for i in range(max(1, len(x) - 2))}
    for i in range(600):
        name = rng.choice(sorted(texts))
        rows.append((i, prose(rng, rng.randrange(40)) + " " + edited(rng, texts[name], rng.choice([0.01, 0.03, 0.06])) + " " + prose(rng, rng.randrange(40))))
        if len(sh(tokens(texts[name])) & sh(tokens(rows[-1][1]))) >= 0.8 * len(sh(tokens(texts[name]))):
            want.add((i, name))
    rows += [(0, "again"), (0, "")]
    got = {(r["doc_id"], r["template"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 200 and len(want - got) <= 0.01 * len(want)


def brute_language(text, by_lang, miss, k):
    """Out-of-place distances with grams as strings; "_" is a word's edge."""
    word = "".join(c.lower() if c.isalpha() else "_" for c in text)
    seq = re.sub("_+", "_", f"_{word}_")
    count = {}
    for n in (1, 2, 3):
        for i in range(len(seq) - n + 1):
            if seq[i : i + n] != "_":
                count[seq[i : i + n]] = count.get(seq[i : i + n], 0) + 1
    code = lambda g: sum((1 if c == "_" else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    top = sorted(count, key=lambda g: (-count[g], code(g)))[:k]
    far = {lang: sum(min(miss, abs(p.index(g) - i)) if g in p else miss for i, g in enumerate(top)) for lang, p in by_lang.items()}
    best = min(sorted(far), key=lambda x: far[x])
    return best, 1 - far[best] / (miss * len(top))


def test_out_of_place_by_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 6))) for _ in range(12)), lang) for i in range(60) for lang, a in [rng.choice([("x", "abcé"), ("y", "abdÖ"), ("z", "bcd")])]]
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 12)) for r in rank_profiles.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), profile=60, doc_profile=40).collect()}
    counts = {}
    code = lambda g: sum((1 if c == "_" else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            seq = "_" + re.sub("_+", "_", "".join(c.lower() if c.isalpha() else "_" for c in t)) + "_"
            for n in (1, 2, 3):
                for j in range(len(seq) - n + 1):
                    if seq[j : j + n] != "_":
                        c = counts.setdefault(lang, {})
                        c[seq[j : j + n]] = c.get(seq[j : j + n], 0) + 1
    profiles = {lang: sorted(c, key=lambda g: (-c[g], code(g)))[:60] for lang, c in counts.items()}
    for i, t, _ in rows:
        lang, score = brute_language(t, profiles, 60, 40)
        assert got[i] == (lang, round(score, 12))


def test_one_of_each(spark):
    rng = random.Random(14)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(4, a), (4, a), (2, a + " end"), (7, b), (7, b + " end"), (None, b), (9, ""), (9, ""), (5, None), (6, "x y")]
    docs_ = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long")
    out = one_of_each(docs_)
    assert out.columns == docs_.columns
    kept = sorted(r["key"] for r in out.collect())
    assert len(kept) == 6 and kept[0] == 2 and kept[1] in (3, 4) and kept[2:] == [6, 7, 8, 9]
    assert one_of_each(docs_.where("false")).count() == 0


def test_lines_of_repeated_ids(spark):
    """Rows that repeat an id and its text share their fate; other rows that repeat an id are told apart."""
    rows = [(1, "one two three four\nfive six seven eight"), (1, "one two three four\nfive six seven eight"), (3, "five six seven eight\nnew line of words"), (3, "nine ten eleven twelve\nfive six seven eight"), (None, "one two three four")]
    out = line_dedup(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, tag int"), min_chars=1)
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in out.collect()) == sorted([(1, rows[0][1]), (1, rows[0][1]), (3, "new line of words"), (3, "nine ten eleven twelve"), (0, "one two three four")])


def test_lines_with_heavy_words(spark, monkeypatch):
    """All words over the limit for light ones, so centres and what they leave do all the work."""
    monkeypatch.setattr("quarrymill.llm.line_dedup._LIGHT", 4)
    rng = random.Random(15)
    base = [prose(rng, 24, 60) for _ in range(6)]
    rows = ["\n".join(edited(rng, rng.choice(base), rng.choice([0, 0.04, 0.08, 0.2])) for _ in range(4)) for _ in range(60)]
    got = {(r["doc_id"], r["line_no"]) for r in repeated_lines(spark.createDataFrame([(i * 3, t) for i, t in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_groups_of_near_copies_do_not_yield_their_pairs(spark, monkeypatch):
    """300 near copies of one line have 45 thousand pairs; the join makes a few for each line, and all copies but the first go."""
    from quarrymill.llm import line_dedup as module

    made = []
    pairs = module._pairs
    monkeypatch.setattr(module, "_pairs", lambda *a: made.append(module.cut(pairs(*a))) or made[-1])
    rng = random.Random(17)
    base = prose(rng, 60, 60)
    rows = [edited(rng, base, 0.02) for _ in range(300)] + [prose(rng, 30, 60) for _ in range(50)]
    got = {(r["doc_id"], r["line_no"]) for r in repeated_lines(spark.createDataFrame([(i * 3, t) for i, t in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert len(got) > 280 and sum(x.count() for x in made) < 10 * len(rows)


def test_lines_of_many_partners_do_not_meet_them_all(spark, monkeypatch):
    """Near copies that the first step leaves unsettled: a share of the lines settles most of them, and only the others meet the rest."""
    from quarrymill.llm import line_dedup as module

    made = []
    pairs, heads = module._pairs, module._head_pairs
    monkeypatch.setattr(module, "_LIGHT", 4)
    monkeypatch.setattr(module, "_head_pairs", lambda met, *a: heads(met, *a).where("doc_id is null"))
    monkeypatch.setattr(module, "_pairs", lambda *a: made.append(module.cut(pairs(*a))) or made[-1])
    rng = random.Random(21)
    base = prose(rng, 60, 400)
    rows = [edited(rng, base, 0.03) for _ in range(200)]
    got = {(r["doc_id"], r["line_no"]) for r in repeated_lines(spark.createDataFrame([(i * 3, t) for i, t in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert len(got) > 150 and sum(x.count() for x in made) < 300 * len(rows)


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_exact_dedup", "op10_ngram_join"])
def test_queries_same_as_sql(spark, name):
    import duckdb

    from quarrymill.llm import queries

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    assert sorted(map(str, df.select(columns).collect())) == sorted(str(r) for r in [spark_row(columns, x) for x in want.select(*columns).fetchall()])


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values, strict=True)))


def test_probabilities_meet_the_marginals(spark):
    """Even targets for sources and languages of very different size: what documents hold is taken in the shares wanted."""
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.randrange(20, 200)), lang, f"s{rng.randrange(3)}") for i, lang in enumerate(rng.choices(["en", "de", "fr"], [16, 4, 1], k=3000))]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for keep in (0.25, 0.6):
        out = raking.mix_to_targets(docs_, keep_share=keep, topic=F.lit("t"))
        held = {r["lang"]: (r["n"], r["p"]) for r in out.groupBy("lang").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("p")).collect()}
        total = sum(n for n, _ in held.values())
        # fr cannot give a third of the sample, nor can de of the larger one: all of them stay, and the others make up
        want = dict.fromkeys(held, 0.0)
        room = {k: n for k, (n, _) in held.items()}
        while abs(keep * total - sum(want.values())) > 1e-6 * total:
            free = [k for k in want if want[k] < room[k]]
            left = (keep * total - sum(want.values())) / len(free)
            want |= {k: min(room[k], want[k] + left) for k in free}
        assert want["fr"] == room["fr"] and (want["de"] == room["de"]) == (keep == 0.6)
        assert all(abs(p - want[k]) < 0.01 * want[k] for k, (_, p) in held.items())
        by_source = [r["p"] for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("p")).collect()]
        assert max(by_source) - min(by_source) < 0.01 * max(by_source)


def test_pipeline_on_odd_rows(spark, texts, tmp_path):
    """Every stage takes nulls in any column, empty and blank texts, repeated rows, a long text, extra columns, and no rows at all."""
    import corpus_pipeline

    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", None][i % 2], None if t is None else len(t), "x", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all here", "en", "a", 3, None, 1), (None, None, None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, h int"
    table = spark.createDataFrame(rows, kinds)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows[:60])] + [(None, 1, None), (0, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "What is the sum of 12 apples and 7 pears in the basket?"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for start in (table, spark.createDataFrame([], kinds)):
            out = stage(spark, start, str(tmp_path))
            assert out.columns == table.columns, name
            n = out.count()
            assert n <= start.count() and (n or start is not table), name
