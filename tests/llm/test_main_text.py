"""Main text of planted pages."""

import random

import numpy as np
from kassabon.llm import main_text

TREE = main_text.grown(*main_text.labelled())
rng = random.Random(4)


def prose(n):
    return " ".join(rng.choice("river stone cloud house green under walk seven".split()) for _ in range(n)).capitalize() + "."


def pages(n):
    """Pages of several layouts, with their main text."""
    for i in range(n):
        body = [prose(rng.choice([1, 2, 3, 8, 30, 70])) for _ in range(rng.randint(3, 9))]
        title = prose(6)
        article = f"<h1>{title}</h1>" + "".join(f"<p>{p.replace('stone', '<b>stone</b>', 1)}" for p in body)
        open_, shut = rng.choice([("<article>", "</article>"), ("<main><article class='post big'>", "</article></main>"), ("<div id='content'>", "</div>"), ("<div class=entryText><div>", "</div></div>"), ("<div>", "</div>")])
        links = "".join(f'<li><a href="/{j}">{prose(2)}</a></li>' for j in range(6))
        before = rng.choice([f"<nav><ul>{links}</ul></nav>", f"<header><h2>{prose(3)}</h2><p>{prose(15)}</p></header>", f'<div class="main-menu">{links}</div>', f'<div id="cookieNotice"><p>{prose(30)}</p><button>OK</button></div>', f"<ul>{links}</ul>"])
        after = rng.choice([f"<footer>&copy; {prose(9)}</footer>", f'<aside><p>{prose(40)}</p></aside><footer>{prose(4)}</footer>', f'<section id="comments"><h2>{prose(2)}</h2><p>{prose(60)}</p></section>', f'<form action="/s"><label>{prose(3)}</label><input value="x > y"><select><option>one</select></form>', f'<div class="ad ad-300">{prose(12)}</div>'])
        yield f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>'</script></head><body class='has-sidebar'><!-- ad {i} -->{before}{open_}{article}{shut}{after}</body></html>", "\n".join([title, *body])


def test_planted_pages():
    given = list(pages(300))
    got = main_text.texts([h for h, _ in given], TREE)
    assert [g for g, (_, want) in zip(got, given, strict=True) if g != want] == []


def test_markup():
    text = lambda html: main_text.texts([html], TREE)[0]
    assert text("<article><p>a &amp; b&nbsp;&lt;c&gt; &eacute;&#233;&#x1F600;</p>\n\n<p>  x <i>y</i>z<br>w\t\n v </p></article>") == "a & b <c> éé😀\nx yz w v"
    assert text("<article><p title='a > b'>one<p data-x=\"'\">two<ul><li>three<li>four</ul></article>") == "one\ntwo\nthree\nfour"
    assert text("<article><p>kept<!-- not <p>this</p> --> too<script>if (a < b) '<p>no</p>'</script></article>") == "kept too"
    assert text("<article><header><h1>Title</h1><p>By nobody at all</p></header><p>Text.</p><footer>Tags</footer></article>") == "Title\nText."
    assert text("<article><p>Text <a href='#'>link</a> more.</p><p><a href='#'>Alone</a></p><p>End.</p></article>") == "Text link more.\nAlone\nEnd."
    assert text("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"
    assert text("<article><p>cut <b>off") == "cut off"
    assert text("<article><p>before</p><script>never closed <p>x</p>") == "before"
    assert text("a < b and 3 <4") == "a < b and 3 <4"
    assert text("") == text("<nav><a href='#'>x</a></nav>") == text("<!-- only") == text("<p title='never closed") == ""


def test_large_and_odd_pages_take_linear_time():
    texts = main_text.texts(["<article>" + "<p>word</p>" * 200_000, "<div>" * 200_000 + "text", "</p>" * 200_000, '<a b="' * 100_000, "<" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "&" * 100_000], TREE)
    assert texts[0].count("\n") == 199_999
    assert texts[1] == "text"


def test_tree_on_its_table():
    rows, labels = main_text.labelled()
    assert np.mean((TREE.share(rows) >= 0.5) == labels) > 0.99
    assert {int(f) for f in TREE.feature} & {main_text.FEATURES.index(f) for f in ("links", "links_before", "links_after")}


def test_report(spark):
    given = [*pages(20), (None, ""), ("", ""), ("<article>😀 é</article>", "😀 é")]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}", h, "t", 1, 2) for i, (h, _) in enumerate(given)]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string, text string, n_chars int, words int").repartition(3)
    got = sorted((tuple(r) for r in main_text.report(df).collect()), key=lambda r: r[0])
    assert got == sorted([(i, u, given[i][1], len(given[i][1])) for i, u, *_ in [*rows, rows[3]]], key=lambda r: r[0])
    assert main_text.report(df.limit(0)).collect() == []
    assert main_text.extracted(df, out="main").columns == [*df.columns, "main"]
