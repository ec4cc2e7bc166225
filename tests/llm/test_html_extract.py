from __future__ import annotations

import random
import re
import time

from cloakframe.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, x, "clash", "clash") for i, u, x in pages], SCHEMA)
    return {r.page_id: r.text for r in h.main_text(df).collect()}


def test_marked_articles_keep_their_text(spark):
    page = """<!DOCTYPE html><html><head><title>T &am</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Menu</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
    <article><header><h1>A &amp; B</h1></header><p><b>One\n two<br>three<p>four&nbsp;five <i>si</i>x<div class="ad">Buy</div><p class=advert>Buy</p>
    <p>last</p><section id="comments"><p>First!</p></section><form><label>Mail</label><input></form></article>
    <aside>More</aside><footer>&copy; x</footer>"""
    got = texts(spark, [(1, "http://a.b/c", page), (2, None, None), (3, "", ""), (4, "x", "<nav>only</nav>"), (5, "http://a.b/c", page)])
    want = "A & B One two three four five six last"
    assert got == {1: want, 2: "", 3: "", 4: "", 5: want}


def test_template_lines_of_unmarked_pages_go(spark):
    def page(own):
        return "<div>Home of things</div><div>" + "".join(f"<p>{x}</p>" for x in own) + "</div><div>Made by us</div>"

    pages = [(i, f"http://h.example/p/{i}", page([f"own {i} line {k}" for k in range(4)])) for i in range(6)]
    pages += [(9, "http://h.example/p/5", page([f"own 5 line {k}" for k in range(4)])), (10, "http://lone.example/", "<div>alone</div>")]
    got = texts(spark, pages)
    for i in range(6):
        assert got[i] == " ".join(f"own {i} line {k}" for k in range(4))
    assert got[9] == got[5]
    assert got[10] == "alone"


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a = rng.choices(range(rng.randint(1, 12)), k=rng.randint(0, 14))
        b = rng.choices(range(rng.randint(1, 12)), k=rng.randint(0, 14))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = h.shared(a, b)
        assert len(got) == best[-1][-1]
        left = iter(b)
        assert all(a[i] in left for i in got)


def test_long_rows_of_repeated_lines_are_aligned():
    rng = random.Random(6)
    a, b = rng.choices([1, 2], k=8000), rng.choices([1, 2], k=8000)
    began = time.time()
    got = h.shared(a, b)
    assert time.time() - began < 8 and len(got) > 6000
    left = iter(b)
    assert all(a[i] in left for i in got)


def test_malformed_pages_cost_their_length():
    for page in ("<a " * 350_000, "<a '" * 260_000, '<a "' * 260_000 + ">", "<a \"'" * 200_000 + "x>", "<!" * 500_000, "</script" * 100_000, "<script>" + "</script" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "&" * 500_000):
        began = time.time()
        h.lines(page)
        assert time.time() - began < 5, page[:20]


def test_malformed_tags():
    text = lambda page: [x.text for x in h.lines(page)]
    assert text("<p>a < b > c</p>") == ["a < b > c"] and text('<p title="x>y">a') == ["a"] and text("<p>it's <b title='>'>b</b>") == ["it's b"]
    assert text("a<!-- <p>b</p>") == ["a"] and text("<p>a<p title='b>c") == ["a", "c"] and text('<p>a <i x="y>b</i> <p>c') == ["a b", "c"]
    assert text("<p>x &am<b>p; &lt;</b>p> &am</p>") == ["x &amp; <p> &am"] and text("a <") == ["a <"] and text("a <b") == ["a <b"]


def test_names_are_told_by_their_words():
    page = "<article><p>kept</p><div %s><p>said</p></div></article>"
    for name in ('class="user-comments"', "class=reader-comments", 'class="wp-sidebar"', 'id="commentsThread"', 'class="cookie-policy-banner"', 'class="x adSlot"', 'id="mainNav"'):
        assert [x.text for x in h._kept_lines((page % name).encode())] == ["kept"], name
    for name in ('class="alert"', 'class="market-share"', 'class="codeComment"', 'id="relatedWork"'):
        assert [x.text for x in h._kept_lines((page % name).encode())] == ["kept", "said"], name
    assert [x.text for x in h._kept_lines(b'<div class="alert">no</div><article class="related"><p>yes</p></article><main class="search"><p>too</p></main>')] == ["yes", "too"]


def test_empty_table(spark):
    assert texts(spark, []) == {}


def test_the_nearest_page_that_differs_is_found_at_any_distance(spark):
    """A small section on a large host, runs of equal and of similar pages, over several ranges."""
    page = lambda menu, own: f"<div>{menu}</div><div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>"
    own = lambda i: [f"own {i} line {k}" for k in range(6)]
    pages, want = [], {}

    def add(path, menu, lines):
        want[len(pages)] = " ".join(lines)
        pages.append((len(pages), f"http://h.example/{path}", page(menu, lines)))

    for i in range(700):
        add(f"a/{i:04}", "Menu of the large section", own(i))
    for i in range(3):
        add(f"b/{i}", "Menu of the small section", own(f"small {i}"))
    for i in range(12):
        add(f"c/1/{i:02}", "Menu three", own("copied"))
    for i in range(12):
        add(f"c/2/{i:02}", "Menu three", [*own("near"), f"{i}"])
    add("c/3", "Menu three", own("last"))
    got = texts(spark, pages)
    odd = {i for i in want if got[i] != want[i]}
    assert not odd, [(pages[i][1], got[i]) for i in sorted(odd)[:3]]


def test_whole_names_and_all_articles_stay(spark):
    named = [f'<article><p class="{c}">Kept {c}</p><p>b</p></article>' for c in ("market-share", "code-comment", "related-work", "search-results")]
    pages = [(i, f"http://h{i}.example/", p) for i, p in enumerate(named)]
    pages += [(8, "http://h8.example/", "<article><p>one</p></article><article><p>two and more</p></article>"), (9, "http://h9.example/", '<article><p class="comment-list">c</p><p class="share-buttons">s</p>text</article>')]
    got = texts(spark, pages)
    assert got == {0: "Kept market-share b", 1: "Kept code-comment b", 2: "Kept related-work b", 3: "Kept search-results b", 8: "one two and more", 9: "text"}


def test_shared_lines_go_outside_articles_and_stay_within(spark):
    page = lambda i: f"<div>Same of all</div><div>Dear reader {i}</div><article><p>Quoted by all</p><p>own {i}</p></article><div>Made by us</div>"
    pages = [(i, f"http://h.example/page?id={i}", page(i)) for i in range(1000)]
    pages += [(2000, None, page(0)), (2000, None, "<article>x</article>")]
    got = sorted((r.page_id, r.text) for r in h.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got[:1000] == [(i, f"Dear reader {i} Quoted by all own {i}") for i in range(1000)]
    assert got[1000:] == [(2000, "Same of all Dear reader 0 Quoted by all own 0 Made by us"), (2000, "x")]


def test_differencing_compares_the_given_pages(spark):
    """All pages but the only one of a host are aligned with a neighbour, and a brute-force pass over each host finds the same texts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    plain = spark.createDataFrame([(r.page_id, r.url, bytearray(r.html.encode())) for r in rows], "row_no long, url string, html binary")
    seen = {r.row_no: (r.compared, r.gone) for r in h.template_places(h._parsed(plain)).collect()}
    hosts = {}
    for r in rows:
        host, path = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", r.url).groups()
        hosts.setdefault(host.lower(), []).append((path, r.url, r.page_id, h._kept_lines(r.html.encode())))
    texts_ = {}
    for host in hosts.values():
        host.sort(key=lambda x: x[:3])
        keys = [[x.text for x in page[3]] for page in host]
        for i, (_, _, page_id, found) in enumerate(host):
            gone, compared = set(), 0
            for side in (-1, 1):
                j = i + side
                while 0 <= j < len(host):
                    common = h.shared(keys[i], keys[j])
                    if sum(len(keys[i][x]) for x in common) <= h.COPY * sum(map(len, keys[i])) and keys[i] != keys[j]:
                        gone |= set(common)
                        compared += 1
                        break
                    j += side
            assert seen[page_id][0] == compared
            texts_[page_id] = " ".join(x.text for k, x in enumerate(found) if k not in gone or x.place == h.ARTICLE)
    assert sum(c > 0 for c, _ in seen.values()) >= 200
    assert texts(spark, [(r.page_id, r.url, r.html) for r in rows]) == texts_
