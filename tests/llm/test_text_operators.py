"""Operators that judge each text by itself, against plain versions."""

import base64
import hashlib
import random
import re
import time
from collections import Counter
import time
import public_tokenizers
import pytest
import tiktoken
from cases import awkward, documents, empty, rows

from tracelake.llm import bpe, decontaminate, html, license_set, licenses, pii, quality

ODD = [None, "", " \t\n ", "a", "a a a a a a a", "x" * 5000, "héllo wörld ÄÖ ß", "日本語のテキスト 123", "tab\tand\x0bvt\x1cfs", "don't we'll I'M 12345 ½ ²  \n\n  end  ", "aaaa" * 3000, "word " * 3000, "😀 emoji 👩‍👩‍👧 ok"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, sf_dir, encoding):
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(awkward(spark, ODD).selectExpr("doc_id + 100000 AS doc_id", "text"))
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = rows(bpe.encode(docs, RANKS, public_tokenizers.PATTERN))
    assert got.keys() == given.keys()
    for k, text in given.items():
        ids = encoding.encode_ordinary(text)
        assert got[k]["ids"] == ids, k
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_long_pretokens_and_random_bytes(encoding):
    codec = bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    r = random.Random(3)
    for text in ("a" * 30_000, "".join(r.choices("ab", k=20_000)), "".join(r.choices("thergionsé ", k=5000)), "".join(chr(r.randrange(1, 0x2FFF)) for _ in range(3000))):
        ids = codec.ids_bytes(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == encoding.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_bpe_of_nothing(spark):
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items):
    words = WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORDS.findall(lower(t))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [64_000_000, 20_000])
def test_decontaminate_equals_brute_force(spark, sf_dir, max_bytes):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, "Short item"), (901, ""), (902, None), (903, "short ITEM"), (904, "a a")]
    docs = documents(spark, sf_dir).select("doc_id", "text")
    extra = awkward(spark, [*ODD, "a a a a", "xshort item", "short-item! short item", (items[3][1] or "") + " tail", "ÄB short é item"]).selectExpr("doc_id + 100000 AS doc_id", "text")
    docs = docs.unionByName(extra)
    got = rows(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), max_bytes=max_bytes))
    hits = 0
    for r in docs.collect():
        n, n_hit, found = brute_hits(r["text"], items)
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) == (n, n_hit, found, n_hit > 0), r
        hits += n_hit > 0
        for s in x["spans"]:
            assert WORDS.fullmatch(lower(r["text"][s["start"] : s["end"]])[:1])
        assert sum(len(WORDS.findall(lower(r["text"])[s["start"] : s["end"]])) for s in x["spans"]) == n_hit
    assert hits > 3
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id bigint, text string"), max_bytes=max_bytes).collect()}
    assert kept == {k for k, x in got.items() if not x["contaminated"]}


@pytest.mark.parametrize("max_bytes", [64_000_000, 20])
def test_decontaminate_by_items_without_id(spark, max_bytes):
    items = spark.createDataFrame([(None, "secret test question"), (7, "other item")], "item_id bigint, text string")
    got = rows(decontaminate.decontaminate(awkward(spark, ["a secret test question here", "clean", "other item"]), items, max_bytes=max_bytes))
    assert [(got[k]["n_hit"], got[k]["items"], got[k]["contaminated"]) for k in range(3)] == [(3, [], True), (0, [], False), (2, ["7"], True)]
    kept = decontaminate.keep_clean(awkward(spark, ["a secret test question here", "clean", "other item"]), items, max_bytes=max_bytes)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, x in got.items() if not x["contaminated"]}


def test_decontaminate_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(empty(spark), none).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(awkward(spark, ODD), none).collect())


def brute_base(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_pii_base_equals_patterns(spark, sf_dir):
    r = random.Random(5)
    texts = ["".join(r.choices("0123456789.-+ ()@ab", k=60)) for _ in range(3000)] + ["".join(r.choices("a@.b%", k=25)) for _ in range(2000)]
    texts += [x["text"] for x in documents(spark, sf_dir).collect()]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t
        assert set(brute_base(t)) <= {*pii.base_spans(t), *pii.disguised_spans(t, pii.base_spans(t))}


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("joe@exаmple.com", "email", "joe@exаmple.com"),
        ("call +1 five five five one two three four five six seven ok", "phone", "+1 five five five one two three four five six seven"),
        ("at 192 dot 168 dot 1 dot 10 there", "ip", "192 dot 168 dot 1 dot 10"),
        ("１９２．１６８．１．１", "ip", "１９２．１６８．１．１"),
        ("ja​ne@mail.example.org", "email", "ja​ne@mail.example.org"),
        ("host 192.168.one.one up", "ip", "192.168.one.one"),
        ("see bob_at_site_dot_org there", "email", "bob_at_site_dot_org"),
        ("write to bob at site.org today", "email", "bob at site.org"),
        ("or jane.doe at example.com", "email", "jane.doe at example.com"),
        ("no: 4１11 1111 1111 1111 yes", "card", "4１11 1111 1111 1111"),
        ("Ümläute é vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ],
)
def test_pii_disguises_map_back(text, kind, span):
    base = pii.base_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in pii.disguised_spans(text, base)] == [(kind, span)]


def test_pii_plain_text_gains_nothing(spark, sf_dir):
    for text in ("see you at example.com", "one two three four", "look at dot com", *[r["text"] for r in documents(spark, sf_dir).collect()]):
        assert pii.disguised_spans(text, pii.base_spans(text)) == []


def disguised(r):
    """A kind, and a disguise of it made by a rule."""
    kind = r.choice(pii.KINDS)
    if kind == "email":
        name = "".join(r.choices("abcdefgh", k=5)) + "." + "".join(r.choices("klmno", k=4))
        site = "".join(r.choices("pqrstu", k=6))
        at, dot = r.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("{@}", "."), (" @ ", " . "), ("_at_", "_dot_"), (" at ", ".")])
        return kind, f"{name}{at}{site}{dot}{r.choice(['com', 'org', 'net'])}"
    digits = "zero one two three four five six seven eight nine".split()
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() and r.random() < 0.5 else c for c in s) + "\u200b"
    if kind == "ip":
        parts = [str(r.randrange(256)) for _ in range(4)]
        return kind, r.choice([" dot ".join(parts), "[.]".join(parts), " (dot) ".join(parts), ".".join([*parts[:2], digits[r.randrange(10)], digits[r.randrange(10)]])])
    if kind == "card":
        d = [r.randrange(10) for _ in range(15)]
        d += [c for c in range(10) if pii.luhn("".join(map(str, [*d, c])))]
        return kind, r.choice([" ".join(digits[c] for c in d), wide("".join(map(str, d))).strip("\u200b").replace("0", "\uff10", 1)]) if 0 in d else " ".join(digits[c] for c in d)
    d = [r.randrange(10) for _ in range(11)]
    return kind, "+" + str(1 + d[0] % 9) + " " + " ".join(digits[c] for c in d)


def test_pii_recall_of_made_disguises():
    r = random.Random(11)
    found, made = Counter(), Counter()
    for _ in range(2000):
        kind, text = disguised(r)
        text = f"Some words, {text}, and more words."
        base = pii.base_spans(text)
        spans = [*base, *pii.disguised_spans(text, base)]
        made[kind] += 1
        found[kind] += any(pii.KINDS[k] == kind and a <= 14 and b >= len(text) - 20 - 3 for a, b, k in spans)
    assert all(found[k] >= 0.9 * made[k] > 0 for k in pii.KINDS), (found, made)


@pytest.mark.parametrize("text", ["x @ y at dot " + " " * 1_000_000, " " * 1_000_000, "@" * 1_000_000, "x @" * 300_000, "a at b dot " * 100_000, "1 " * 500_000, "one " * 250_000, "a_at_" * 200_000, "x" + " (" * 500_000, "1.one." * 150_000])
def test_pii_of_very_long_texts(text):
    began = time.time()
    pii.disguised_spans(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_pii_query_and_redaction(spark):
    docs = awkward(spark, [*ODD, "a@b.co and 10.0.0.1", "x at y dot com"])
    got = rows(pii.digest(pii.find(docs)))
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[len(ODD)]["spans"] == "email:0:6,ip:11:19"
    assert (got[len(ODD) + 1]["n_email"], got[len(ODD) + 1]["spans"]) == (0, "email:0:14")
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert red[len(ODD)] == "[EMAIL] and [IP]" and red[0] is None
    assert pii.find(empty(spark)).collect() == []


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 4000 else None
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover) if cover is not None else None


def test_quality_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(awkward(spark, [*ODD, "a b c a b c d", "l\nl\n \nl"]).selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = rows(quality.measure(docs))
    for r in docs.collect():
        x = got[r["doc_id"]]
        n, chars, symbols, dup, repeat = brute_quality(r["text"])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"]) == (n, chars, symbols, dup), r
        if repeat is not None:
            assert x["n_repeat_words"] == repeat, r
        assert x["base_failed"] == (n < 50 or 100 * x["n_repeat_words"] > 50 * n)
        assert not (x["base_failed"] and x["kept"])
    assert quality.measure(empty(spark)).collect() == []


def test_quality_rejects_by_lines(spark):
    good = "\n".join("Some " + " ".join(f"w{k}v{j}" for j in range(9)) + "." for k in range(12))
    nav = "\n".join(" | ".join(f"item{k}{j}" for j in range(12)) for k in range(8))
    shout = "\n".join(" ".join(f"WORD{k}X{j}!!" for j in range(12)) + "." for k in range(8))
    symbols = "\n".join(" ".join(f"word{k}x{j}***" for j in range(12)) for k in range(8))
    half = good + "\n" + "\n".join(" | ".join(f"m{k}{j}" for j in range(6)) for k in range(3))
    got = rows(quality.measure(awkward(spark, [good, nav, shout, symbols, half])))
    assert [got[k]["kept"] for k in range(5)] == [True, False, False, False, True]
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(awkward(spark, [good, nav, half])).collect()}
    assert cleaned[2] == good and 1 not in cleaned


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav>
<div id="sidebar"><p>side, side, side text here long enough to count as a paragraph.</p></div>
<div class="content"><h1>Title</h1><p>First para, with   commas,
and more text, good stuff to be long enough.<p>Second para &amp; more, with text &eacute;, long enough for a paragraph.<ul><li>item one<li>item two</ul>
<form><input><p>form text</p></form><script>var a = "<p>no</p>";</script><div class="comments"><p>reader comment, long, with commas, a, b, c, d</p></div></div>
<div class="cookie-notice">We use cookies, ok, fine, sure.</div><footer>foot</footer></body></html>"""


def test_html_keeps_the_article():
    assert html.extract(PAGE) == "Title\nFirst para, with commas, and more text, good stuff to be long enough.\nSecond para & more, with text é, long enough for a paragraph.\nitem one\nitem two"
    for broken in ("", "   ", "<", "<p", "plain words only", "<div><p>a<b>c", "<script>x", "<!-- c", '<a href="x>y</a> text', "</p></div>", "<p>a</p>" * 2000, "<div>" * 3000 + "deep"):
        html.extract(broken)
    assert html.extract("plain &lt;words&gt;  only") == "plain <words> only"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "<p>a b</p>" * 60_000, "<b>" * 60_000 + "<p>a</p>" * 60_000, "<i>" * 60_000 + "</x>" * 60_000, "<table>" + "<b>" * 50_000 + "<tr>x" * 50_000, "<ul>" + "<li>x<div>" * 50_000, "<" * 500_000, "<a href='" * 50_000, "<p " * 200_000])
def test_html_of_very_long_pages(page):
    began = time.time()
    html.extract(page)
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "wrap",
    [
        "<form id=aspnetForm>{}</form>",
        "<form><article>{}</article></form>",
        '<div class="content no-sidebar">{}</div>',
        '<div class="post-content has-footer">{}</div>',
        '<div class="article-body comments-open">{}</div>',
        '<div id="article" class="widget">{}</div>',
        '<div class="sidebar">{}</div>',
    ],
)
def test_html_keeps_articles_in_forms_and_doubtful_names(wrap):
    paras = [f"Paragraph {k} of the article, with commas, and words enough to count, as they do." for k in range(6)]
    body = "".join(f"<p>{p}</p>" for p in paras)
    noise = '<nav><a href=/>home</a></nav><div class="post-comments"><p>A comment, short.</p></div><form><p>Your name, please, and mail.</p></form>'
    for page in (wrap.format(body) + noise, wrap.format(body + '<div class="entry-share">Share, now.</div>') + noise):
        got = html.extract(f"<html><body>{page}</body></html>")
        if "sidebar" in wrap and "no-sidebar" not in wrap:
            assert all(p in got for p in paras)
        else:
            assert got == "\n".join(paras)


def test_html_equals_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = rows(html.extract_pages(pages), "page_id")
    import html as stdlib

    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(stdlib.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>hi</p>", "y"), (1, None, None, "x")], "page_id bigint, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html.extract_pages(odd).collect()) == [(0, "hi"), (1, ""), (1, "")]
    assert html.extract_pages(odd.where("false")).collect() == []


def test_licenses_found_by_window_and_containment(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = set()
    for r in docs.collect():
        words = " ".join(re.findall(r"[^\W_]+", r["text"].lower()))
        for k, t in licenses.TEMPLATES.items():
            if f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " in f" {words} ":
                want.add((r["doc_id"], k))
    found = licenses.scan(docs).collect()
    assert want and want <= {(r["doc_id"], r["license"]) for r in found}
    assert all(r["containment"] >= 0.8 for r in found)
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no charge")
    texts = [*ODD, "lead " * 200 + mit + " tail" * 300, edited, " ".join(mit.split()[:20]), licenses.TEMPLATES["ISC"] + "\n" + licenses.TEMPLATES["MPL-2.0"]]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(awkward(spark, texts)).collect()}
    n = len(ODD)
    assert {k for k in got if k[0] is not None} == {(n, "MIT"), (n + 1, "MIT"), (n + 3, "ISC"), (n + 3, "MPL-2.0")}
    assert texts[n][got[n, "MIT"]["start"] : got[n, "MIT"]["end"]] == mit.rstrip(".")
    assert licenses.scan(empty(spark)).collect() == []


def test_licenses_by_their_right_names():
    given = license_set.templates()
    index = licenses.Index(given)
    find = lambda t: {k for k, *_ in index.find(re.findall(r"[^\W_]+", t.lower()), 0.8)}
    for text, name in (
        ("This project is licensed under the MIT License.", "MIT-notice"),
        ("Licensed under the Apache License 2.0.", "Apache-2.0-notice"),
        ("It is released under the BSD 2-Clause License.", "BSD-2-Clause-notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-notice"),
        ("Available under the Eclipse Public License 2.0", "EPL-2.0-notice"),
    ):
        assert find("some lead words here " + text + " and a tail") == {name}, text
    notice = licenses.TEMPLATES["GPL-3.0-or-later"]
    assert find(notice) == {"GPL-3.0-or-later"} and find(notice.replace("version 3", "version 2")) == {"GPL-2.0-or-later"}
    assert find(notice.replace("General Public", "Lesser General Public")) == {"LGPL-3.0-or-later"}
    assert find(notice.replace("General Public", "Affero General Public")) == {"AGPL-3.0-or-later"}
    for name, text in given:
        if len(text) > 6000:
            assert name in find("lead " * 50 + text + " tail" * 50), name


def test_license_places_are_of_the_source(spark):
    notice = "This program is licensed under the terms of the Demo License as it stands here"
    docs = spark.createDataFrame([(1, "\u0130\u0130\u0130\u0130 " + notice), (2, "x " * 100_000 + notice), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["start"], r["end"]) for r in licenses.scan(docs, {"demo": notice}).collect()}
    assert got == {1: (5, 5 + len(notice)), 2: (200_000, 200_000 + len(notice))}


def test_html_articles_in_containers_of_unsure_names():
    said = "Many words are said here, and more of them follow. "
    short = f'<div class="sidebar"><p>{said * 4}</p></div><div id="col"><p>Short news.</p></div>'
    assert html.extract(short) == "Short news."
    article = "An article, with text. " * 55
    for name in ("contact", "legal", "rating", "search", "skip", "form", "alert", "share"):
        page = f'<div class="{name}"><p>{article}</p></div><div><p>Copyright 2024 by someone, all rights are reserved by them, yes.</p></div>'
        assert article.strip() in html.extract(page), name
        page = f'<div id="x"><p>{article}</p></div><div class="{name}"><p>{said}</p></div>'
        assert said.strip() not in html.extract(page), name
    assert html.extract('<div class="sidebar"><p>Nothing else is here.</p></div>') == "Nothing else is here."


def test_pii_and_licenses_of_many_finds_take_linear_time():
    text = " ".join(f"user{k}@example{k % 97}.com" for k in range(100_000)) + " jane (at) example (dot) org"
    t = time.time()
    base = pii.base_spans(text)
    assert len(base) == 100_000 and len(pii.disguised_spans(text, base)) == 1 and time.time() - t < 30
    index = licenses.Index([("a", "one two three four five six seven eight"), ("b", "three four five six seven eight nine ten eleven twelve")])
    words = "one two three four five six seven eight nine ten eleven twelve x y z".split() * 8000
    t = time.time()
    found = index.find(words, 0.5)
    assert len(found) == 8000 and time.time() - t < 30
