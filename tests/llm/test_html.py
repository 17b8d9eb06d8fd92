import random
import time

import numpy as np
import pytest

from tessera.llm import html_extract as H, repeats
from tessera.llm.html_extract import Settings, blocks_of, main_text, shared_starts


def test_blocks_and_parts():
    page = """<!DOCTYPE html><html><head><title>x &amp; y</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
    <div class="cookie-notice">We use cookies</div><header><a>Site</a></header><nav><ul><li>Home</ul></nav>
    <article><h1>Title &amp;&nbsp;more</h1><p><b>One</b>two<br>three <i>it</i>alic<p>Unclosed &lt;tag&gt;
    <form><input>Mail<textarea><p>no</textarea></form><ul><li>a<li>b</ul><aside>rel</aside><table><tr><td>c<td>d</table>
    <div id="comments"><article>nice!</article></div><!-- <p>gone</p> --></article>
    <div class="ad">Buy</div><section role="complementary">side</section><footer>&copy; f</footer></body></html>"""
    assert blocks_of(page) == (["Title & more", "Onetwo three italic", "Unclosed <tag>", "a", "b", "c", "d"], True)


def test_odd_pages():
    assert blocks_of("") == ([], False)
    assert blocks_of("just text") == (["just text"], False)
    assert blocks_of("<p>a < b & c") == (["a < b & c"], False)
    assert blocks_of("<main><p>x</main><p>y") == (["x"], True)
    assert blocks_of("<div class='post-content'><p>x</p></div><p>y") == (["x"], True)
    assert blocks_of("<nav><a>Home</a><main>kept</main>") == (["kept"], True)
    assert blocks_of("<p title='a>b'>q</p><p hidden>h</p><script>x") == (["q"], False)
    assert blocks_of("<form action=x><article><p>inside</p></article></form>") == (["inside"], True)


@pytest.mark.parametrize(
    "body",
    [
        "<div class='site-content no-sidebar'><article><p>x</p></article></div><p>y</p>",
        "<article class='post category-social tag-menu'><p>x</p></article><p>y</p>",
        "<article class='post social'><p>x</p></article><p>y</p>",
        "<div class='sidebar'><article><p>x</p></article></div><p>y</p>",
        "<main><h1 class='title'></h1><div class='widget'><article><p>x</p></article></div></main><p>y",
        "<div id='has-comments'><main class='menu'><p>x</p></main></div>",
        "<article><p>x</p><div class='comments-area'><article>nice</article></div></article>",
        "<main><p>x</p><ol class='comment-list'><li><article class='comment'>nice</article></ol></main>",
        "<article><p>x</p></article><section class='related'><article>other</article></section>",
        "<article><p>x</p><div class='share-buttons'>s</div><div id='cookie_notice'>c</div><div class='cookie-bar'>c</div><div class='site-footer'>f</div></article>",
        "<article><div class='entry no-share with-ads'><p>x</p></div></article>",
        "<aside><article>teaser</article></aside><div class='comments'><article><p>x</p></article></div><p>y</p>",
    ],
)
def test_class_names_do_not_take_the_article(body):
    assert blocks_of(body) == (["x"], True)


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h2 class='banner'>Real title</h2><p class='search'>Search para</p></article>", ["Real title", "Search para"]),
        ("<article><p>a</p><p class='related'>b</p><div class='related'><p>c</p></div><p class='ad'>d</p><p class='cookie-notice'>e</p></article>", ["a", "b"]),
        ("<article><div class='widget'><p>all of it</p></div></article><p>y</p>", ["all of it"]),
        ("<main><article><div class='notice'>x</div></article><p>y</p></main>", ["y"]),
        ("<p class='search'>q</p><article><p>z</p></article>", ["z"]),
        ("<article><div class='widget'><nav>menu</nav>text</div></article>", ["text"]),
    ],
)
def test_class_names_in_an_article_are_signals(body, text):
    assert blocks_of(body) == (text, True)


def page(body):
    return f"<html><body>{body}</body></html>"


def test_shared_runs_go_and_unique_runs_stay(spark, monkeypatch):
    for block in (1024, 2):
        monkeypatch.setattr(H, "BLOCK", block)
        rng = random.Random(4)
        word = lambda: f"w{rng.randrange(10**6)}"
        banner = " ".join(f"boiler{i}" for i in range(15))
        rows, want = [], {}
        for i in range(30):
            host = f"h{i % 2}.example.com"
            unique = " ".join(word() for _ in range(40))
            twice = " ".join(word() for _ in range(14))
            rows.append((i, f"http://{host}/{i}", page(f"<p>{banner}</p><p>{unique}</p><p>{twice}</p><p>tail {twice}</p><div>{banner} end{i}</div>"), 1))
            want[i] = f"{unique}\n{twice}\ntail {twice}\nend{i}"
        rows.append((100, "http://alone.example.com/", page(f"<p>{banner}</p>"), 1))
        want[100] = banner
        rows.append((107, "http://h0.example.com/b", page(f"<h1>{banner}</h1><p>{banner}</p><p>own {word()} words</p><ul><li><a>More</a></ul>"), 1))
        want[107] = "\n".join([banner, banner, " ".join(rows[-1][2].split("<p>")[2].split("</p>")[0].split())])
        rows.append((101, None, page("<p>no host</p>"), 1))
        want[101] = "no host"
        copy = " ".join(word() for _ in range(50))
        rows += [(102, "http://copies.example.com/1", page(f"<p>{copy}</p>"), 1), (103, "http://copies.example.com/2", page(f"<p>{copy}</p>"), 1)]
        want[102] = want[103] = copy
        rows += [(104, "http://h0.example.com/a", page(f"<article><p>{banner}</p></article>"), 1), (105, "u", None, 1), (106, None, "", 1)]
        want |= {104: banner, 105: "", 106: ""}
        rows.append(rows[3])
        got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        out = got.collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_a_marked_page_shows_the_boilerplate_of_others(spark):
    menu, foot = " ".join(f"menu{i}" for i in range(6)), " ".join(f"foot{i}" for i in range(9))
    link = lambda t: "".join(f"<li><a>{w}</a></li>" for w in t.split())
    own = lambda i: [" ".join(f"p{i}w{k}x{j}" for j in range(9)) for k in range(3)]
    body = lambda i: "".join(f"<p>{t}</p>" for t in own(i))
    marked = f"<nav><ul>{link(menu)}</ul></nav><div class='ad'>buy this now{{}}</div><article><h1>One title</h1>{{}}</article><footer>{foot}</footer>"
    bare = marked.replace("nav>", "div>").replace(" class='ad'", "").replace("article>", "div>").replace("footer>", "div>")
    rows = [(i, "http://a.example.com/", page((bare if i % 2 else marked).format(i // 4, body(i)))) for i in range(12)]
    out = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i].text == "\n".join(["One title", *own(i)])


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 100_000 + "</p>" * 100_000, "<p><div>" + "<b>" * 100_000 + "<hr>" * 100_000, "<a \"><b '>" * 100_000, "<div class=ad>" + "<article>" * 60_000, "<ul><li>" * 100_000, "<a '" * 250_000, "<" * 1_000_000, "<a x=" + " " * 1_000_000])
def test_odd_pages_take_time_in_proportion(source):
    began = time.process_time()
    blocks_of(source)
    assert time.process_time() - began < 10


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_starts_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        texts = [rng.integers(0, 3, rng.integers(1, 15)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        pages = rng.integers(0, 3, len(texts))
        several = rng.random(len(texts)) < 0.2
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        width = int(rng.integers(1, 5))
        where = {}
        for t, p, s in zip(texts, pages, several):
            for i in range(len(t) - width + 1):
                where.setdefault(t[i : i + width].tobytes(), set()).update({int(p)} | ({"other"} if s else set()))
        want = [i + width <= len(t) and len(where[t[i : i + width].tobytes()]) > 1 for t in texts for i in range(len(t))]
        assert shared_starts(np.concatenate(texts), offsets, pages, several, width).tolist() == want


def test_settings_are_used():
    assert repeats.BLOCK >= 1 and Settings().gram < Settings().width


@pytest.mark.parametrize("block", [1024, 2])
def test_the_index_judges_what_is_in_doubt_in_marked_articles(spark, monkeypatch, block):
    """Paragraphs of a part's name and links at the ends go if the host repeats them; passages without such signs stay."""
    monkeypatch.setattr(H, "BLOCK", block)
    many = lambda w, n=12: " ".join(f"{w}{i}" for i in range(n))
    notice, passage, menu = many("notice"), many("passage"), "".join(f"<li><a href=x>menu{i}</a></li>" for i in range(9))
    made = lambda i: page(f"<article><ul>{menu}</ul><h2 class='banner'>{notice}</h2><p>{many(f'p{i}x')}</p><p class='banner'>{notice}</p><p class='search'>{many(f'q{i}x')}</p><p>{passage}</p><p>end{i}</p></article>")
    rows = [(i, "http://a.example.com/", made(i)) for i in range(4)] + [(4, "http://b.example.com/", made(4)), (5, "http://b.example.com/5", made(4))]
    rows += [(6, "http://a.example.com/", page(f"<article><p class='banner'>{notice}</p></article>")), (7, "http://a.example.com/", page(f"<article><p>own</p><p class='banner'>{notice} more</p></article>"))]
    want = {i: "\n".join([notice, many(f"p{i}x"), many(f"q{i}x"), passage, f"end{i}"]) for i in range(4)} | {6: notice, 7: f"own\n{notice} more"}
    want[4] = want[5] = "\n".join([*(f"menu{i}" for i in range(9)), notice, many("p4x"), notice, many("q4x"), passage, "end4"])
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want and len(out) == 8 and all(r.n_chars == len(r.text) for r in out)
