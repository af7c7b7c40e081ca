"""Operators over the whole corpus and the pipeline, against brute force and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import awkward, documents, empty, rows

from tracelake.llm import components, eliasfano, ngram, paragraphs, simhash, toxicity


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 300)] + [(500, 500), (601, 600), (600, 601), (602, 600)]
    nodes = sorted({x for e in edges for x in e})
    got = {r["node"]: r["label"] for r in components.min_labels(spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(n, n) for n in nodes], "node bigint, label bigint")).collect()}
    want = union_find(nodes, edges)
    assert got == {n: r for n, r in want.items() if n != 500}


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    fps = {}
    for i, f in pairs:
        fps.setdefault(f, []).append(i)
    distinct = sorted(fps)
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2]
    roots = union_find(distinct, links)
    least = {}
    for f, ids in fps.items():
        least[roots[f]] = min([least.get(roots[f], math.inf), *(i for i in ids if i is not None)])
    return {i: least[roots[f]] for f, ids in fps.items() for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(awkward(spark, [None, "", " ", "A b", "a B", "one two three", "one two three one two three"]).where("doc_id is not null").selectExpr("doc_id + 100000 AS doc_id", "text"))
    given = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = rows(simhash.digest(simhash.near_duplicates(docs)))
    assert {i: x["fingerprint"] for i, x in got.items()} == {i: f"{f:016x}" for i, f in given}
    assert {i: x["component_id"] for i, x in got.items()} == brute_components(given)


def test_simhash_links_of_crowded_blocks(spark):
    """A family around one fingerprint (so crowded block keys), chains and the sign bit."""
    r = np.random.default_rng(7)
    centre = 0x8123_4567_89AB_CDEF
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (300, 2))} | {int(x) for x in r.integers(0, 1 << 63, 200)} | {0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    mask = (1 << 64) - 1
    got = {x["node"] & mask: x["label"] & mask for x in components.min_labels(edges, spark.createDataFrame([(f, f) for f in signed], "node bigint, label bigint")).collect()}
    plain = sorted(fps)
    want = union_find(plain, [(a, b) for k, a in enumerate(plain) for b in plain[k + 1 :] if (a ^ b).bit_count() <= 2])
    same = lambda labels: {frozenset(f for f in plain if labels.get(f, f) == x) for x in {labels.get(f, f) for f in plain}}
    assert same(got) == same(want)


def test_simhash_keeps_one(spark):
    docs = awkward(spark, ["same text of a few words", "same text of a few words", "another text that differs a lot", None, ""])
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [0, 2, 3] and kept.count(None) == 1
    assert simhash.keep_one(docs).columns == docs.columns
    ties = spark.createDataFrame([(7, "b words of this row", "x"), (7, "a words of that one", "y"), (7, "a words of that one", "y"), (8, None, "z")], "doc_id bigint, text string, `__id` string")
    assert sorted(tuple(r) for r in simhash.keep_one(ties).collect()) == [(7, "a words of that one", "y"), (8, None, "z")]
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []


_WORD = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]|[^\\s\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]+")


def words_of(text):
    return [w.lower() for w in _WORD.findall(text)]


def brute_units(text):
    """(line, first word, words) of lines of 20 words and of runs of shorter ones."""
    out, held, at = [], [], 0
    for k, line in enumerate([*(text or "").split("\n"), ""]):
        w = words_of(line)
        if held and (not w or len(w) >= paragraphs.MIN_WORDS):
            words = [x for _, _, y in held for x in y]
            out += [(*held[0][:2], words)] if len(words) >= paragraphs.MIN_WORDS else []
            held = []
        if len(w) >= paragraphs.MIN_WORDS:
            out.append((k, at, w))
        elif w:
            held.append((k, at, w))
        at += len(w)
    return out


def brute_repeated(texts):
    """Paragraphs linked at a Jaccard similarity of 0.8 over 5-word shingles, all pairs."""
    paras = [(d, a, k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))) for d, t in texts if d is not None for k, a, w in brute_units(t)]
    paras.sort(key=lambda p: p[:2])
    edges = [(i, j) for i in range(len(paras)) for j in range(i) if len(a := paras[i][3]) and len(a & paras[j][3]) >= 0.8 * len(a | paras[j][3])]
    roots = union_find(range(len(paras)), edges)
    size = Counter(roots.values())
    return {(paras[i][0], paras[i][2]): ((paras[r][0], paras[r][2]), size[r]) for i, r in roots.items() if size[r] > 1}


def test_paragraphs_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = " ".join(f"w{k}" for k in range(90))
    family = [base.replace(f"w{k} ", f"x{k} ") for k in range(0, 80, 2)]  # each near the base, not each other
    texts = [None, "", "short line", base, *family, base, "other " + base, "\n" + base + "\nshort", " ".join(f"v{k}" for k in range(25))]
    docs = docs.unionByName(awkward(spark, texts).selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = {(r["doc_id"], r["para"]): ((r["cluster_doc"], r["cluster_para"]), r["copies"]) for r in paragraphs.repeated(docs, windows=False).collect()}
    want = brute_repeated([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(want) > 40
    assert got == want
    assert paragraphs.repeated(empty(spark)).collect() == []


def test_crowded_band_keys_lose_no_link(spark):
    """Texts around one passage: their lines share a band with very many that aren't like them, and pairs of them are."""
    r = np.random.default_rng(3)
    common = [f"c{k}" for k in range(40)]
    own = [[f"o{x}" for x in r.integers(0, 1 << 40, 30)] for _ in range(60)]
    texts = [" ".join(common + own[k % 60][: 30 - k // 60]) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shingles = {d: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in enumerate(texts))}
    pairs = spark.createDataFrame([(1, d) for d in shingles], "key bigint, hash bigint")
    sets = spark.createDataFrame([(d, [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in s]) for d, s in shingles.items()], "hash bigint, shingles array<bigint>")
    got = {(x["a"], x["b"]) for x in paragraphs.across(pairs, spark.createDataFrame([], "a bigint, b bigint"), sets).collect()}
    want = {(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    assert got == want and len(want) >= 60
    clusters = {x["doc_id"]: x["cluster_doc"] for x in paragraphs.repeated(docs, windows=False).collect()}
    assert clusters == {d: d % 60 for d in range(120)}


def repeated_windows(texts):
    """First words of windows of 50 words that stand in two documents, twice apart in one, or in a repeated row."""
    where = {}
    for d, t in texts:
        w = words_of(t or "")
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    out = {}
    for places in where.values():
        if len(places) == 1:
            continue
        apart, held = max(p for _, p in places) - min(p for _, p in places), set(places)
        if max(places)[0] > min(places)[0] or apart >= 50 or (len(places) > 1 and apart == 0):
            for d, i in places:
                if not any((d, i + k) in held or (d, i - k) in held for k in range(1, 50)):  # repeats that overlap count once
                    out.setdefault(d, set()).add(i)
    return out


def hold_spans_against_windows(docs, found):
    """Every repeated window of 50 words holds a whole span of 20 and more, and every span is a repeat. Returns the documents that must be found."""
    given = {x["doc_id"]: x["text"] or "" for x in docs.collect()}
    spans, words = {}, {d: np.array([m.span() for m in _WORD.finditer(t)], np.int64).reshape(-1, 2) for d, t in given.items()}
    for x in found:
        own = words[x["doc_id"]]
        a, b = np.searchsorted(own[:, 0], x["start"]), np.searchsorted(own[:, 1], x["end"])
        assert own[a, 0] == x["start"] and own[b, 1] == x["end"] and b - a + 1 == x["n_words"] >= 20 and x["copies"] > 1
        assert x["para"] == given[x["doc_id"]].count("\n", 0, x["start"])
        assert x["cluster_doc"] <= x["doc_id"] and (x["removed"] or x["doc_id"] == x["cluster_doc"])
        spans.setdefault(x["doc_id"], []).append((a, b))
    want = repeated_windows(list(given.items()))
    for d, firsts in want.items():
        covered = np.zeros(len(words[d]), bool)
        for a, b in spans.get(d, []):
            covered[a : b + 1] = True
        run = np.concatenate(([0], np.cumsum(covered)))
        assert all(run[i + 50] - run[i] >= 20 for i in firsts), d
    return want


def test_no_repeated_passage_of_fifty_words_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert len(hold_spans_against_windows(docs, paragraphs.repeated(docs).collect())) > 100


def test_passages_within_and_across_lines(spark, sf_dir):
    r = np.random.default_rng(4)
    fill = lambda n: " ".join(f"f{x}" for x in r.integers(0, 1 << 40, n))
    shared = [f"s{k}" for k in range(50)]
    inside = [f"{fill(150)} {' '.join(shared)} {fill(int(n))}" for n in (170, 3)]
    wrapped = fill(30) + "\n" + "\n".join(" ".join(shared[k : k + 7]) for k in range(0, 50, 7)).upper() + "\n\n" + fill(9)
    glyphs = "".join(chr(0x4E00 + int(x)) for x in r.integers(0, 5000, 60))
    texts = [None, "", *inside, wrapped, fill(20) + " " + " ".join(shared[:10]) + " " + fill(20), "一二" + glyphs + "三", fill(7) + glyphs + "四五", "a " * 300, fill(3) + " İx " + " ".join(shared[:50])]
    texts += [f"{(p := fill(80))} {fill(5)} {p}", fill(200_000)]
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(awkward(spark, texts).where("doc_id is not null").selectExpr("doc_id + 100000 AS doc_id", "text"))
    found = paragraphs.repeated(docs).collect()
    want = hold_spans_against_windows(docs, found)
    assert {100002, 100003, 100004, 100006, 100007, 100009, 100010} <= want.keys()
    assert not {100000, 100001, 100005} & {x["doc_id"] for x in found}


def test_paragraphs_of_short_lines(spark):
    words = [f"w{k}" for k in range(60)]
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    near = ["x", *words[1:]]
    got = {x["doc_id"]: (x["para"], x["start"], x["cluster_doc"]) for x in paragraphs.repeated(awkward(spark, ["t\n\n" + wrap(words, 8), wrap(near, 11), wrap(words[:15], 8)]), windows=False).collect()}
    assert got == {0: (2, 3, 0), 1: (0, 0, 0)}


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 5), (1000, 2000), (20_000, 1 << 40), (3000, 1 << 64)])
def test_elias_fano_holds_and_finds(tmp_path, n, universe):
    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, universe, n, dtype=np.uint64, endpoint=False)) if n else np.zeros(0, np.uint64)
    eliasfano.save(str(tmp_path / "s"), **eliasfano.encode(values, universe))
    s = eliasfano.Sequence(eliasfano.load(str(tmp_path / "s")))
    asked = np.concatenate([values, r.integers(0, universe, 500, dtype=np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert s.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    assert (s.get(np.arange(len(values))) == values).all()
    here, behind = s.get_pair(np.arange(max(0, len(values) - 1)))
    assert (here == values[:-1].astype(np.int64)).all() and (behind == values[1:].astype(np.int64)).all()
    begin = r.integers(0, n + 1, len(asked))
    stop = np.minimum(len(values), begin + r.integers(0, n + 1, len(asked)))
    found = [place.get(int(v), -1) for v in asked]
    assert s.find(asked, begin, stop).tolist() == [i if a <= i < b else -1 for i, a, b in zip(found, begin.tolist(), stop.tolist(), strict=True)]


def test_ngram_tokens_are_those_of_split():
    r = np.random.default_rng(7)
    pieces = ["a", "A", "ab", "abcdefgh", "abcdefghi", "Ünï", "\x00", "a\x00", "\x1f", "\x85", "\u2003", "x" * 63, "x" * 64, "x" * 65, "X" * 65 + "y", "y" * 500, " ", "\t", "\n", "\r\n", "\x0b", "\x0c"]
    texts = [b"", b"\n", b" a", *("".join(r.choice(pieces, size)).encode() for size in r.integers(0, 60, 300)), b""]
    index, known, sizes = ngram.indexed(texts)
    want = [[*t.lower().split(), b"\n"] for t in texts]
    assert sizes.tolist() == [len(t) for t in want]
    flat = [w for t in want for w in t]
    of = dict(zip(flat, known[index].tolist(), strict=True))
    assert len(set(of.values())) == len(of) == len(known) and [of[w] for w in flat] == known[index].tolist()


def test_ngram_scores_equal_brute_force_and_beat_the_base(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(awkward(spark, [None, "", "word", "unseenword another"]).where("doc_id is not null").selectExpr("doc_id + 100000 AS doc_id", "text"))
    given = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b"\n"]) for r in docs.collect()]
    train = [t for d, t in given if zlib.crc32(str(d).encode()) % 10]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"\n", *t], t, strict=False))
    three = Counter(p for t in train for p in zip([b"\n", *t], t, t[1:], strict=False))
    n, v, (k, k3) = sum(one.values()), len(one), ngram.PRIORS
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    got = {}
    for r in ngram.score(docs, ngram.train(docs)).collect():
        got.setdefault(r["doc_id"], r)
    two_levels = {r["doc_id"]: r["score"] for r in ngram.score(docs, ngram.train(docs, priors=ngram.PRIORS[:1])).collect()}
    p2 = lambda h, w: (two[h, w] + k * p1(w)) / (one[h] + k)
    p3 = lambda g, h, w: (three[g, h, w] + k3 * p2(h, w)) / (two[g, h] + k3)
    base_sum = pair_sum = score_sum = tokens = 0
    for d, t in given:
        base = sum(math.log10(p1(w)) for w in t)
        pair = sum(math.log10(p2(h, w)) for h, w in zip([b"\n", *t], t, strict=False))
        score = math.log10(p2(b"\n", t[0])) + sum(math.log10(p3(g, h, w)) for g, h, w in zip([b"\n", *t], t, t[1:], strict=False))
        x = got[d]
        assert x["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(one[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
        assert x["score"] == pytest.approx(score, abs=3e-4 * len(t))
        assert two_levels[d] == pytest.approx(pair, abs=3e-4 * len(t))
        if x["held_out"]:
            base_sum, pair_sum, score_sum, tokens = base_sum + base, pair_sum + pair, score_sum + score, tokens + len(t)
    perplexity = [10 ** (-x / tokens) for x in (base_sum, pair_sum, score_sum)]
    assert perplexity[2] < 0.95 * perplexity[1] < 0.95 * perplexity[0]
    unseen = 0.1 / (n + 0.1 * (v + 1))
    total = sum(p2(b"\n", w) for w in one) + k * unseen / (one[b"\n"] + k)
    assert total == pytest.approx(1)
    g, h = max(((g, h) for g, h, _ in three), key=lambda x: two[x])
    assert sum(p3(g, h, w) for w in one) + k3 * k * unseen / (one[h] + k) / (two[g, h] + k3) == pytest.approx(1)


def test_ngram_of_order_four_equals_brute_force(spark):
    r = np.random.default_rng(4)
    given = {d: [*(b"%c" % c for c in r.integers(97, 101, d % 13)), b"\n"] for d in range(400)}
    docs = spark.createDataFrame([(d, b" ".join(t[:-1]).decode()) for d, t in given.items()], "doc_id long, text string")
    priors = (20.0, 5.0, 3.0)
    counts, contexts = Counter(), Counter()
    for d, t in given.items():
        if zlib.crc32(str(d).encode()) % 10:
            t = (b"\n", *t)
            counts.update(t[1:])
            for i in range(1, len(t)):
                for size in range(1, min(i, 3) + 1):
                    counts[t[i - size : i + 1]] += 1
                    contexts[t[i - size : i]] += 1
    words = [w for w in counts if isinstance(w, bytes)]
    n = sum(counts[w] for w in words)

    def p(h, w):
        if not h:
            return (counts[w] + 0.1) / (n + 0.1 * (len(words) + 1))
        k = priors[len(h) - 1]
        return (counts[(*h, w)] + k * p(h[1:], w)) / (contexts[h] + k)

    for x in ngram.score(docs, ngram.train(docs, priors=priors)).collect():
        t = (b"\n", *given[x["doc_id"]])
        want = sum(math.log10(p(t[max(0, i - 3) : i], t[i])) for i in range(1, len(t)))
        assert x["score"] == pytest.approx(want, abs=5e-4 * len(t))


def test_ngram_of_nothing(spark):
    assert ngram.score(empty(spark), ngram.train(empty(spark))).collect() == []
    docs = awkward(spark, [None, "a b"]).where("doc_id = 0")
    one = ngram.score(docs, ngram.train(docs.where("false"))).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in one} == {(1, 0, 0)}


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs, labels, model, rows(toxicity.score(docs, model))


def test_toxicity_held_out_accuracy(scored):
    docs, labels, model, got = scored
    held = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels.collect() if toxicity.crc32(r["doc_id"]) % 3 == 1]
    right = sum((s >= toxicity.THRESHOLD) == bool(y) for y, s in held)
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert right / len(held) > 0.98 and auc > 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_toxicity_marginals_equal_plain_forward_backward(scored):
    """Products of 2x2 matrices along each sequence, in place of messages as ratios; every word has features."""
    model = scored[2]
    texts = [["plain", "idiot", "of", "the", "moron", "scum", "and", "so", "on"], [], ["a"], [f"w{k}" for k in range(100)] + ["trash"]]
    got, sizes = model.tag(texts)
    assert sizes.tolist() == [9, 0, 1, 101]
    w, step, want = model.weights, np.exp(model.transitions), []
    for text in texts:
        for k in range(0, len(text), toxicity.SEQUENCE):
            part = text[k : k + toxicity.SEQUENCE]
            f = [toxicity.features_of(x) for x in part]
            e = [model.bias + sum(float(w[x]) for x in f[i][: toxicity._OWN]) + (w[f[i - 1][toxicity._BEFORE]] if i else 0) + (w[f[i + 1][toxicity._AFTER]] if i + 1 < len(f) else 0) for i in range(len(f))]
            psi = [np.diag([1.0, np.exp(min(x, 30.0))]) for x in e]
            for i in range(len(part)):
                ahead, back = np.ones(2) @ psi[0], np.ones(2)
                for x in psi[1 : i + 1]:
                    ahead = ahead @ step @ x
                for x in psi[:i:-1]:
                    back = step @ x @ back
                want.append((ahead * back)[1] / (ahead @ back))
    assert got == pytest.approx(np.array(want), rel=1e-5, abs=1e-9)
    assert got[1] > 0.5 and got[4] > 0.5 and got[-1] > 0.5 and got[3] < 0.5
    # what stands beside a word counts: the same word has another marginal elsewhere
    assert len({round(float(model.tag([[a, "word", b]])[0][1]), 9) for a in ("the", "idiot") for b in ("so", "scum")}) == 4


def test_toxicity_of_nothing(spark, scored):
    model = scored[2]
    got = toxicity.score(awkward(spark, [None, "", "x" * 3000]), model).collect()
    assert all(r["score"] < toxicity.THRESHOLD and r["spans"] == [] for r in got)
    spans = toxicity.score(awkward(spark, ["you Idiot, you SCUM and idiot!", "\u0130\u0130\u0130 you idiot"]), model).orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in spans if r["doc_id"] is not None] [:2] == [[(4, 9), (15, 19), (24, 29)], [(8, 13)]]
    long = " ".join(f"w{k}" for k in range(300_000))
    assert toxicity.score(awkward(spark, [long]), model).where("doc_id = 0").first()["score"] < toxicity.THRESHOLD
    assert toxicity.score(empty(spark), model).collect() == []
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(awkward(spark, ["a"]), none).collect()[0]["score"] == 0.0
    named = spark.createDataFrame([("a", None), ("b", "mild words"), ("b", "mild words"), (None, "x")], "doc_id string, text string")
    marks = spark.createDataFrame([("a", 0), ("b", 1), ("b", 0), ("b", 0), ("c", 1), (None, 1), ("a", None)], "doc_id string, toxic int")
    model = toxicity.train(named, marks)  # ids that aren't numbers; no word tells: the share of label 1
    assert {r["score"] for r in toxicity.score(named, model).collect()} == {model.rate} and 0 < model.rate < 1


def test_pipeline_stages_take_effect(spark, scored):
    import corpus_pipeline
    from test_text_operators import brute_hits

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given = rows(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    left = {i: x for i, x in given.items() if model.scores(model.tag([toxicity.words_of(x["text"])]))[0] < toxicity.THRESHOLD}
    comp = brute_components([(i, brute_fingerprint(x["text"])) for i, x in left.items()])
    left = {i: x for i, x in left.items() if comp[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {i: x for i, x in left.items() if not brute_hits(x["text"], items)[1]}
    out = rows(corpus_pipeline.run(spark, d))
    assert out.keys() == left.keys() and 0 < len(out) < len(given)
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, d)
        assert frame.columns == docs.columns, name
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    import hashlib

    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == {i: x["decoded_sha256"] for i, x in out.items()}


def test_pipeline_of_awkward_rows(spark):
    """Nulls, empty texts, repeated rows, an empty table and extra columns pass every stage with their columns."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    texts = [None, "", "plain words of a text that nobody minds", "write to a.b@c.org now", "w " * 100_000]
    for given in (awkward(spark, texts), empty(spark)):
        frame = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, d)
            assert frame.columns == given.columns, name
        got = corpus_pipeline.STAGES[-1][1](spark, frame, d).collect()
        assert sorted(str(r["doc_id"]) for r in got) == (["0", "2", "3", "4", "None"] if given.count() else [])
        kept = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert not kept or kept[3] == "write to [EMAIL] now"
