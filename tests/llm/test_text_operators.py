"""Licence expressions, main text of pages, and the two classifiers on held-out documents."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.llm import html_text, licenses, quality, toxicity
from citespark.llm.common import id_crc


def brute_scan(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "", "Apache License, Version 2.0", "MIT-License mit license MIT LICENSE", "cc by cc by", "GNU General\nPublic   License v3 and cc-by 4.0",
    "gnu general public", "permit license", "mit licenses", "café mit license", "mit\x85license", "a\tmit\x00license!",
]


def test_base_places_by_definition():
    scan = licenses.scanner()
    for text in TEXTS:
        assert scan(text)[:5] == brute_scan(text), text


def test_base_places_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = licenses.scan_licenses(docs).select("text", "scan.*").collect()
    assert any(r["n_base"] for r in rows)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "expression, postfix, labels, freedom",
    [
        ("mit", "mit", {"mit"}, 0.9),
        ("mit or gpl-2.0-only", "mit gpl-2.0-only or", {"mit", "gpl"}, 0.9),
        ("mit or gpl-2.0 and apache-2.0", "mit gpl-2.0 apache-2.0 and or", {"mit", "gpl", "apache"}, 0.9),
        ("(mit or gpl-2.0) and apache-2.0", "mit gpl-2.0 or apache-2.0 and", {"mit", "gpl", "apache"}, 0.9),
        ("gpl-2.0-or-later with classpath-exception-2.0", "gpl-2.0-or-later classpath-exception-2.0 with", {"gpl"}, 0.5),
        ("gpl-2.0 with x and mit", "gpl-2.0 x with mit and", {"gpl", "mit"}, 0.5),
        ("somethingelse", "somethingelse", set(), 0.1),
        ("((mit", "mit", {"mit"}, 0.9),
        ("mit and", "mit", {"mit"}, 0.9),
    ],
)
def test_expressions(expression, postfix, labels, freedom):
    tokens = licenses.tokens_after(expression, 0)
    assert licenses.to_postfix(tokens) == postfix.split()
    assert licenses.evaluate(licenses.to_postfix(tokens)) == (labels, pytest.approx(freedom))


def test_tags_add_labels():
    scan = licenses.scanner()
    row = scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1+ */\nnext line GPL-3.0")
    assert row[5] == "apache,lgpl,mit" and row[4] == "" and row[6] == pytest.approx(0.4)
    assert scan("SPDX-License-Identifier:")[5] == ""
    assert scan("no license here")[6] == licenses.NO_NOTICE


def test_unknown_identifiers_are_labels():
    scan = licenses.scanner()
    for name in ("Zlib", "OFL-1.1", "Artistic-2.0", "CDDL-1.0", "0BSD"):
        assert scan(f"SPDX-License-Identifier: {name}")[5:] == (name.lower(), licenses.UNKNOWN)
    assert scan("SPDX-License-Identifier: (Zlib OR MIT) AND GPL-2.0 WITH Classpath-exception-2.0")[5] == "gpl,mit,zlib"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header>Site name</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>%s
<aside>Side</aside><div id="comments"><p>Nice post!</p></div><form><label>Mail</label><input></form><script>var x="</p>";</script>
<footer>&copy; Me</footer></body></html>"""
BODY = "<h1>Big &amp; <b>bold</b>\n title</h1><p>First   paragraph of the text,<br>with words.</p><ul><li>One item of a list</li></ul><p>Er.</p>"
LINES = "Big & bold title\nFirst paragraph of the text,\nwith words.\nOne item of a list\nEr."


def test_pages_with_and_without_article(spark):
    costs = {"li": 12.0, "a": 12.0, "p": 0.02, "h1": 0.02, "ul": 12.0}
    assert html_text.Page(PAGE % f"<article>{BODY}</article>").text(costs) == LINES
    assert html_text.Page(PAGE % f'<div class="post">{BODY}</div>').text({"p": 0.02}) == LINES
    for broken in ("", "<p", "<!-- open", "<div class='a\"b'>", "<script>never closed", "</p></div>", "<nav><nav>"):
        assert html_text.Page(broken).text({}) == ""
    assert html_text.Page('<div class="ad"><p>text after an open advert').text({}) == "text after an open advert"
    assert html_text.Page("a &lt;b&gt; c&nbsp;&#100;").text({}) == "a <b> c d"


@pytest.mark.parametrize(
    "html, kept",
    [
        ('<article><div class="article-header"><h1>Title</h1></div><p>Text</p></article>', "Title\nText"),
        ('<main class="main-content sidebar-right"><p>Text</p><div class="left-sidebar">no</div></main>', "Text"),
        ('<article class="comment"><p>no</p></article><article><p>Text</p></article>', "Text"),
        ('<div class="page-with-sidebar"><p>Some text of it</p></div><div class="site-header">no</div>', "Some text of it"),
        ('<article><p>A</p><p class="notice">no</p><div role="navigation">no</div><p>B</p></article>', "A\nB"),
        ('<article><p>a<script>if (a<b && c=="x>) {</script>b</p></article>', "ab"),
    ],
)
def test_names_of_elements(html, kept):
    assert html_text.Page(html).text({"p": 0.02}) == kept


def test_run_leaves_out_links_at_the_edges():
    menu = "".join(f"<div><a href=x>Link{i}</a></div>" for i in range(5))
    text = "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(3))
    page = html_text.Page(f"<body>{menu}{text}{menu}</body>")
    assert page.text({"a": 12.0, "div": 3.0, "p": 0.02}).count("\n") == 2
    assert "Link" not in page.text({"a": 12.0, "div": 3.0, "p": 0.02})


def test_pages_of_the_table(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html_text.extract_main_text(pages).collect()
    for r in rows:
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)>", article.replace("<b>", "").replace("</b>", ""))
        lines = [" ".join(unescape(b).split()) for b in blocks]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_the_mark_of_an_article_is_no_rule():
    costs = {"div": 6.0, "p": 0.02, "h1": 0.02, "article": 12.0}
    story = "".join(f"<p>{'word ' * 60}</p>" for _ in range(5))
    for html in (
        f"<body><div>{story}</div><article><p>{'teaser ' * 20}</p></article></body>",
        f"<body><article><p>{'teaser ' * 20}</p></article><div>{story}</div></body>",
    ):
        assert html_text.Page(html).text(costs).count("word") == 300
    two = f"<body><article>{story}</article><div>{'between ' * 30}</div><article>{story}</article></body>"
    assert html_text.Page(two).text(costs).count("word") == 600
    page = html_text.Page("<body><article><p>some words of text</p></article></body>")
    assert page.text({"p": 5.0}) == "some words of text"


def test_learned_costs_find_the_marked_articles(spark, sf_dir):
    """The marks are taken away before the scan; what it finds is held against them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    costs = html_text.learn_costs(pages)
    same = total = 0
    for r in pages.collect():
        marked = html_text.Page(r["html"])
        expected = {b for b, inside in zip(marked.blocks, marked.inside) if inside}
        found = set(html_text.Page(re.sub("</?article>", "", r["html"])).text(costs).split("\n"))
        same, total = same + len(expected & found), total + len(expected | found)
    assert same / total >= 0.95


def test_costs_come_from_marked_pages_among_many(spark):
    rows = [(i, "<div><p>plain</p></div>") for i in range(300)] + [(300, "<div>x</div><ARTICLE><p>text</p></ARTICLE>")]
    costs = html_text.learn_costs(spark.createDataFrame(rows, "page_id long, html string"), sample_pages=1)
    assert costs["div"] == html_text.COST_OUTSIDE and costs["p"] == html_text.COST_INSIDE


def held_out(spark, module, fit, score, label, folds, fold, limit):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = id_crc(F.col("doc_id")) % folds == fold
    model = fit(docs, labels, ~out)
    column = score(model)(F.col("text"))
    rows = docs.filter(out).join(labels, "doc_id").filter(F.col(label).isNotNull()).select(label, column.alias("s")).toPandas()
    y, p = rows[label].to_numpy() == 1, rows["s"].to_numpy() >= limit
    assert ((rows["s"] >= 0) & (rows["s"] <= 1)).all()
    return (p & y).sum() / max(1, y.sum()), (~p & ~y).sum() / max(1, (~y).sum())


def test_toxicity_held_out(spark):
    found, clean = held_out(spark, toxicity, toxicity.fit_toxicity, toxicity.toxicity_score, "toxic", 3, 1, 0.7)
    # some labels of the small tables mark texts without any toxic word
    assert found > 0.9 and clean > 0.99


def test_lines_of_the_fit_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 60, rng.integers(1, 20))
        bound = int(rng.integers(len(sizes), 800))
        most = quality.lines_each(sizes, bound)
        kept = np.minimum(sizes, most).sum()
        assert kept <= bound or most == 1
        assert kept == sizes.sum() or np.minimum(sizes, most + 1).sum() > bound
    assert quality.run_of_lines("a\nb\nc", 3, 5) == "a\nb\nc"
    runs = {quality.run_of_lines("a\nb\nc\nd", 2, key) for key in range(40)}
    assert runs == {"a\nb", "b\nc", "c\nd"}
    seen = []
    fit = quality.fit_chain
    monkeypatch.setattr(quality, "fit_chain", lambda x, counts, y, **more: seen.append(counts) or fit(x, counts, y, **more))
    rows = [(i, "\n".join(["Whole sentences stand here." if i % 2 else "| x | 12"] * (400 if i < 4 else 5)), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, F.lit(True), sample_lines=300)
    assert seen[0].sum() == 300 and sorted(set(seen[0].tolist())) == [5, 30]
    good, bad = model.score([rows[5][1], rows[4][1]])
    assert good > 0.7 and bad < 0.3


def test_quality_held_out(spark):
    good, bad = held_out(spark, quality, quality.fit_quality, quality.quality_score, "quality", 5, 0, 0.3)
    assert good > 0.98 and bad > 0.95


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 4])
    emit, move = rng.standard_normal(8), rng.standard_normal((2, 2))
    marginal, pairs, logz = quality.forward_backward(emit, counts, move)
    at, expected_pairs = 0, np.zeros((2, 2))
    for d, n in enumerate(counts):
        weights = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        assert np.isclose(np.log(z), logz[d])
        for k in range(n):
            assert np.isclose(sum(w for y, w in weights.items() if y[k]) / z, marginal[at + k])
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                expected_pairs[a, b] += w / z
        at += n
    assert np.allclose(pairs, expected_pairs)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    raw = rng.standard_normal(300)
    xs, ys = toxicity.isotonic(raw, (rng.random(300) < 1 / (1 + np.exp(-3 * raw))).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= -1e-12).all()


def test_disguised_words():
    assert toxicity.disguised_words(b"an id10t and a m.o.r.o.n e-mail 100 ok.") == ["idiot", "moron", "email"]


def test_vector_sql_agrees(spark, sf_dir):
    from citespark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    expected = con.sql(ORACLE["op5_vector_dups"]).fetchall()
    got = [tuple(r) for r in QUERIES["op5_vector_dups"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(expected)


STORY = "".join(f"<p>{'word ' * 40}</p>" for _ in range(6))


@pytest.mark.parametrize(
    "shape",
    [
        '<div class="content nav-open">%s</div>', '<div class="login-required">%s</div>', '<div class="post share-enabled">%s</div>',
        '<main><div class="article-body widget">%s</div></main>', '<div class="related-work">%s</div>', '<div class="header-text">%s</div>',
        '<div class="comments-open">%s</div>', '<article><section class="social-history">%s</section></article>',
        '<article><div role="main" class="notice-board">%s</div></article>', "<article><fieldset>%s</fieldset></article>",
        '<div class="wrapper light-header">%s</div>', '<div class="modal-open">%s</div>', "<article><math><mi>word</mi></math>%s</article>",
    ],
)
def test_names_do_not_take_an_article(shape):
    aside = '<div class="ad">Buy this</div><div class="comment-list">%s</div><div class="cookie-notice">%s</div>' % ("talk " * 400, "crumbs " * 60)
    text = html_text.Page(f"<body><nav><a href=x>Menu</a></nav>{aside}{shape % STORY}{aside}<footer>Foot</footer></body>").text({"p": 0.02})
    assert text.count("word") == 240 + ("<math>" in shape)
    for other in ("Buy", "talk", "crumbs", "Menu", "Foot"):
        assert other not in text


def test_names_learn_their_costs():
    hint = '<article><p>word</p><div class="related-work"><p>four words in here</p></div></article>'
    page = html_text.Page(hint)
    assert page.inside_tags[".related"] == 1
    assert page.text({"p": 0.02}) == "word"
    assert page.text({"p": 0.02, "div": 0.02, ".related": 0.02}) == "word\nfour words in here"


@pytest.mark.parametrize(
    "html",
    [
        "<nav>" * 100_000, "<nav><p>x</p>" * 20_000, '<div class="related-work">' * 20_000, '<a "' * 25_000, "<title " * 20_000,
        "<title>" + "</title " * 20_000 + ">", "<!--" * 25_000, "<a 'x>" * 20_001, '<div class="related-work">' * 10_000 + "<p>w</p>" + "</div>" * 10_000,
    ],
)
def test_hostile_pages_take_linear_time(html):
    import time

    begun = time.process_time()
    html_text.Page(html).text({})
    assert time.process_time() - begun < 5
