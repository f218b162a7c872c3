"""Divergence and collocations against plain versions; wrappers against pages with known articles."""

import html as htmllib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, divergence, markup, wrappers

RNG = random.Random(11)
TERMS = ["".join(RNG.choice("abcdeé日") for _ in range(RNG.randint(1, 4))) for _ in range(40)]
ASCII = {c: c + 32 for c in range(65, 91)}


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(TERMS[: 3 + i % 38]).title() + r.choice(["", "", "", ".", ",", "1"]) for _ in range(r.randint(0, 60))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, t, r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "b", "é", None, "B"]), 1, "x") for i, t in enumerate(texts(200, 1))]
    out += [(3, None, "en", "a", 1, "x"), (None, "", "de", "a", 1, "x"), (None, "1 2 3 !", "de", "z", None, "x"), (4, "Solo solo", "xx", "a", 1, "x"), *[(9, "the same row é", "en", "copy", 1, "x")] * 4]
    return out + [(5, "-".join(TERMS) * 300, "en", None, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term int, value string").repartition(4)


# --- 11 ------------------------------------------------------------------------------------------

def plain_divergence(rows, least=3, top=200):
    cells, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        ts = [t.translate(ASCII) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        cells[lang, source].update(ts)
        df[lang].update(set(ts))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        p = {}
        for s in sources:
            n = sum(cells[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (cells[lang, s][t] + 1) // (n + v) for t in kept}
        whole = {t: sum(cells[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n + 1) // (sum(whole.values()) + v) for t, n in whole.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v_, k + 1) for k, (v_, _, o) in enumerate(pair)}
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if cells[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v_, k + 1) for k, (v_, _, t) in enumerate(term)}
    return out


def test_divergence_is_the_plain_one(docs, rows):
    got = divergence.divergence(docs)
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows)
    assert dict(got.dtypes)["value"] == "bigint"


def test_divergence_top_cuts_terms_only(docs, rows):
    assert {tuple(r) for r in divergence.divergence(docs, least=1, top=5).collect()} == plain_divergence(rows, 1, 5)


def test_divergence_without_kept_terms_or_rows(spark, docs):
    few = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, None, "en", None)], "doc_id long, text string, lang string, source string")
    got = {tuple(r) for r in divergence.divergence(few).collect()}
    assert got == {("en", a, "pair", b, 0, k + 1) for a in ("", "s", "t") for k, b in enumerate(sorted({"", "s", "t"} - {a}))}
    assert divergence.divergence(docs.filter("false")).count() == 0


def test_shares_beyond_64_bits_are_exact(spark):
    n, total, v = 3 * 10**12, 7 * 10**12, 11
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + v)


# --- 12 ------------------------------------------------------------------------------------------

def plain_collocations(rows, least, inside=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {w: a for w, a in c.items() if len(w) > 1 and a >= least}
        longer = defaultdict(int)
        for w, a in cand.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longer[w[i : i + k]] = max(longer[w[i : i + k]], a)
        best = []
        for w, a in cand.items():
            if 100 * longer[w] >= inside * a and longer[w]:
                continue
            s, k = min((2_000_000 * a // (c[w[:k]] + c[w[k:]]), k) for k in range(1, len(w)))
            best.append((-s, -a, " ".join(w).encode(), " ".join(w), a, c[w[:k]], c[w[k:]], s))
        out |= {(lang, i + 1, p, a, l, r, n[lang], s) for i, (_, _, _, p, a, l, r, s) in enumerate(sorted(best)[:top])}
    return out


@pytest.mark.parametrize("least", [2, 5, 30])
def test_collocations_are_the_plain_ones(docs, rows, least):
    more = [*rows, *[(i, "new york city hall, new york city; big New York.", "en", "a", 1, "x") for i in range(7)], (1, "a a a a a a a a a a a", None, "a", 1, "x")]
    df = docs.sparkSession.createDataFrame(more, docs.schema).repartition(3)
    want = plain_collocations(more, least)
    assert {tuple(r) for r in collocations.collocations(df, least).collect()} == want
    assert want or least == 30


def test_names_that_are_joined_give_what_held_ones_give(docs, rows, monkeypatch):
    held = {tuple(r) for r in collocations.collocations(docs, 3).collect()}
    monkeypatch.setattr(collocations, "HELD_WORDS", 0)
    monkeypatch.setattr(collocations, "HELD_PAIRS", 0)
    monkeypatch.setattr(collocations, "BLOCK", 300)
    assert {tuple(r) for r in collocations.collocations(docs, 3).collect()} == held == plain_collocations(rows, 3)


def test_collocations_in_small_blocks_and_top(docs, rows, monkeypatch):
    """Texts over several blocks, pieces whole; the limit of a language."""
    blocks = collocations.coded(docs).count()
    monkeypatch.setattr(collocations, "BLOCK", 50)
    df = docs.coalesce(1)
    assert collocations.coded(df).count() > blocks + 10
    assert {tuple(r) for r in collocations.collocations(df, 3, top=10).collect()} == plain_collocations(rows, 3, top=10)


def test_collocations_of_an_empty_table(docs):
    assert collocations.collocations(docs.filter("false")).count() == 0
    assert collocations.collocations(docs.filter("text IS NULL")).count() == 0


def test_codes_come_back_and_lose_what_has_no_neighbour():
    import numpy as np

    for top in (0, 7, 65535, 65536, 10**6):
        c = np.array([0, top, 1, 0], np.int64)
        assert (collocations.unpacked(collocations.packed(c)) == c).all()
    assert list(collocations.squeezed(np.array([0, 0, 3, 0, 0, 1, 2, 0, 5]))) == [1, 2, 0]


# --- 13 ------------------------------------------------------------------------------------------

def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def article(i):
    """Blocks of an article: a title, paragraphs with inline markup and references, a list, a quotation."""
    r = random.Random(i)
    out = [("h1", words(5, i * 31)), ("p", words(30 + r.randint(0, 60), i * 31 + 1))]
    for k in range(r.randint(2, 7)):
        kind = r.choice(["p", "p", "p", "h2", "ul", "blockquote"])
        if kind == "ul":
            out += [("li", words(8, i * 31 + k * 7 + j)) for j in range(3)]
        else:
            out.append((kind, words(4 if kind == "h2" else 40, i * 31 + k * 7 + 100) + (" & <b> ü" if kind == "p" else "")))
    return out


def body(blocks):
    out = []
    for k, (kind, text) in enumerate(blocks):
        inner = htmllib.escape(text)
        if kind == "p":
            first, _, rest = inner.partition(" ")
            inner = f"{first}\n\t <a href='/x?a=1&b=2'><em>{rest[:6]}</em></a>{rest[6:]}<!-- note -->"
            text = " ".join(htmllib.unescape(f"{first} {rest}").split())
        out.append(("<ul>" if kind == "li" and (k == 0 or blocks[k - 1][0] != "li") else "") + f"<{kind}>{inner}" + (f"</{kind}>" if kind != "li" or k % 2 else "") + ("</ul>" if kind == "li" and (k + 1 == len(blocks) or blocks[k + 1][0] != "li") else ""))
    return "".join(out)


MENU = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("home", "news", "about")) + "</ul>"
SITES = {
    "plain": "<html><body><nav>{menu}</nav><article>{body}</article><footer>&copy; {noise}</footer>",
    "classes": "<html><head><title>{noise}</title><style>p{{a:b}}</style></head><body class='has-sidebar'><div id=header><h1>Site name</h1>{menu}</div><div class='cookie-notice'><p>We use cookies {noise}</p></div><div class='main sidebar-left'><div class='post-content'>{body}</div><div class=sidebar><p>{noise} {noise}</p></div><div id='comments'><p>{noise} {noise} {noise} {noise}</p></div></div><div class=footer><p>{noise}</p></div></body></html>",
    "bare": "<body><div>{menu}</div><div>{body}</div><div><p>All rights reserved</p></div></body>",
    "tables": "<table><tr><td>{menu}</td><td>{body}</td></tr></table><script>var x = '<p>no</p>';</script>",
    "main": "<header><p>{noise}</p></header><main><article class=post>{body}</article><aside><p>{noise}</p></aside><section class=comments><article class=comment><p>{noise}</p></article></section><form><label>Name</label><p>Leave a reply</p></form></main><noscript>{noise}</noscript>",
}


def page(site, i):
    noise = words(6, 10_000 + i)
    return SITES[site].format(menu=MENU, body=body(article(i)), noise=noise)


@pytest.mark.parametrize("site", SITES)
def test_articles_of_a_site_are_found_whole(spark, site):
    n = 24
    pages = spark.createDataFrame([(i, f"https://user@{site}.example.org:80/{i}?q", page(site, i), "x", "y") for i in range(n)], "page_id long, url string, html string, text string, host string").repartition(3)
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    assert len(got) == n
    for i in range(n):
        want = "\n".join(" ".join(t.split()) for _, t in article(i))
        assert got[i].text == want, (site, i)
        assert got[i].n_chars == len(want)


def test_a_host_of_many_partial_wrappers_is_one_wrapper(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    pages = spark.createDataFrame([(i, "http://a.b/x" if i % 3 else "http://c.d", page("classes" if i % 3 else "plain", i)) for i in range(60)], "page_id long, url string, html string").repartition(20)
    found = wrappers.infer(pages).collect()
    assert sorted(r.host for r in found) == ["a.b", "c.d"]
    import json

    assert {json.loads(r.wrapper)[wrappers.PAGES] for r in found} == {40, 20}


def test_pages_that_are_odd(spark):
    rows = [(1, None, None), (2, "http://h/1", ""), (3, "no host", "just text &amp; more\n here"), (None, "http://h/2", "<p>a<p>b<br>c<div>d"), (5, "http://h/3", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "http://h/4", "<nav>" + MENU), (6, "http://h/4", "<nav>" + MENU), (7, "http://i/", "<p>" + "long " * 200_000), (8, "http://j/", "<a b=\"" * 2000 + "<p>x"), (9, "http://k/", "<p>1 < 2 &lt; 3&nbsp;&hearts; <!-- <p>no</p> --> <!doctype x> ok</p>")]
    got = sorted(((r.page_id or 0, r.text[:40], r.n_chars) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == [(0, "a\nb c\nd", 7), (1, "", 0), (2, "", 0), (3, "just text & more here", 21), (5, "deep", 4), (6, "", 0), (6, "", 0), (7, ("long " * 8), 999_999), (8, "x", 1), (9, "1 < 2 < 3 ♥ ok", 14)]
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_finds_optional_and_repeated_tokens():
    one = wrappers.wrapper_of("<div class=a>x</div><ul><li>1<li>2</ul><p>y</p>")
    wrappers.add(one, wrappers.wrapper_of("<div class=a>x</div><p>z</p><h2>t</h2><p>w</p>"), True)
    assert wrappers.expression(one) == "<div.a>#</> <ul>( <li>#</> )+</>? ( <p>#</>? <h2>#</>? )+"
    same = {t[wrappers.SIG]: t[wrappers.SAME] is not None for t in one[wrappers.KIDS]}
    assert same["div.a"] and not same["p"]


def test_the_reader_of_markup_keeps_what_a_browser_shows():
    show = lambda page: [e[1] for e in markup.events(page) if e[0] == markup.TEXT]
    assert show("<TABLE><tr><td>a<td>b<tr><td>c</TABLE>") == ["a", "b", "c"]
    assert show("<dl><dt>a<dd>b<dt>c</dl>d") == ["a", "b", "c", "d"]
    assert show("<p>a <button>no</button>b</p><select><option>x<option>y</select>c") == ["a b", "c"]
    assert show("<p title='a > b'>x</p><p hidden>y</p>") == ["x", "y"]
    assert show("<head><title>t</title><p>x") == ["x"]
    assert show("<script>if (a < b) '</p>'</script><style>x</style>y<script>open") == ["y"]


def test_hidden_paragraphs_and_alerts_of_an_article_go():
    page = "<article><h1>T</h1><p>one</p><p hidden>no</p><p style='display:none'>no</p><div role=alert>no</div><p>two</p></article>"
    assert wrappers.text_of(page, wrappers.rules_read(wrappers.rules(wrappers.wrapper_of(page)))) == "T\none\ntwo"


def test_the_given_pages_give_their_articles(spark):
    d = Path("/root/testdata/sf0.001/pages.parquet")
    if not d.exists():
        pytest.skip("no data")
    pages = spark.read.parquet(str(d))
    got = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?(p|h1|b|br)>", lambda m: "\n" if m[1] in ("p", "h1") else " ", r.html[r.html.find("<article>") + 9 : r.html.find("</article>")])
        want = [" ".join(htmllib.unescape(x).split()) for x in inner.split("\n")]
        assert got[r.page_id] == "\n".join(x for x in want if x)
