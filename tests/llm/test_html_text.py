import os
import random
import re
import time

import numpy as np
import pytest

from runlake.llm import html_text as H

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(500):
        a, b = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in range(2))
        found = H.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        halved = H._subsequence(a, b, most_bits=4)
        for rows in (found, halved):
            left = iter(b)
            assert len(rows) == lcs(a, b) and rows == sorted(set(rows)) and all(a[i] in left for i in rows)


def test_lines_and_places():
    page = """<!doctype html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
      <header>Top</header><nav class=menu><ul><li>Home<li>More</ul></nav><div class="ad-box">Buy</div><!-- <p>no</p> -->
      <article><h1>A  &lt;b&gt;\n title</h1><p>One <b>bold</b><br>two&nbsp;&#233;<p title="a > b">Next &xyzzy; 1 < 2
      <div class="comments"><p>Nice!</p></div><aside>Side</aside><form><p>Mail</p></form></article><footer>&copy; x"""
    lines = H.page_lines(page)
    assert [t for p, _, t in lines if p == H.ARTICLE] == ["A <b> title", "One bold two é", "Next &xyzzy; 1 < 2"]
    assert [t for p, _, t in lines if p == H.LANDMARK] == ["Top", "Home", "More", "Buy", "Nice!", "Side", "Mail", "© x"]
    assert H.page_lines(None) == H.page_lines("") == []
    assert [t for _, _, t in H.page_lines("plain & text <p>unclosed <b")] == ["plain & text", "unclosed <b"]


def told(page, place=H.ARTICLE):
    return [t for p, _, t in H.page_lines(page) if p == place]


def test_landmarks_within_a_block_leave_it_whole():
    page = """<article><p>Real text <span class="ad">Buy now</span> goes on</p><p>a <button>Subscribe</button> b</p><noscript>Enable JS</noscript>
      <p>c <a class="share" href=x>sh</a> d <span hidden>h</span><select><option>o1<option>o2</select> e<iframe src=x>frame</iframe> f
      <div><p>g <span class=ad>open <p>h</div></article><p>out"""
    assert told(page) == ["Real text goes on", "a b", "c d e f", "g", "h"] and told(page, H.BODY) == ["out"]
    assert told(page, H.LANDMARK) == ["Buy now", "Subscribe", "Enable JS", "sh", "h", "o1", "o2", "open"]


def test_class_words_within_an_article():
    page = """<article><h1 class="post-header">T</h1><section class="related-work"><p>x</section><div class="related-posts">r</div>
      <div class="header">p</div><ul class="comment-list"><li>c</ul></article><div class="page-header">q</div>"""
    assert told(page) == ["T", "x"] and told(page, H.LANDMARK) == ["r", "p", "c", "q"]


def test_quotes_in_attributes():
    assert told("<p title=it's>One</p><p>two</p><p>I don't know > three</p>", H.BODY) == ["One", "two", "I don't know > three"]
    assert told("<p title='a > \"b'>One<p title=\"it's > x\" class=y/>two<p a=\"b>three</p><p>four", H.BODY) == ["One", "two", "three", "four"]
    assert told("<p>a</ >b</>c<!x>d<?y>e<!-- > -->f &#" + "0" * 6000 + "65; &#" + "9" * 6000 + ";", H.BODY) == ["abcdef A \ufffd"]


def test_long_broken_pages_take_linear_time():
    n = 1 << 20
    parts = (
        "<a", "<a ", '<a b="', '<a b=">" ', "<p title=it's>", "</script", "<!--", "<!", "</", "<", "<div>", "<p><button><b>", "<span class=ad>x", "&#9", "<li>",
        "<script>", "<table><td>", "'\"", "<a b='c\"",
    )
    pages = [x * (n // len(x)) for x in parts] + ["<b>" * (n // 8) + "</i></b>" * (n // 8), "<script>" + "</script" * (n // 8), "<a " + "x" * n, "&#" + "9" * n]
    start = time.process_time()
    for x in pages:
        H.page_lines(x)
    # Some two seconds a page at most; quadratic work would take hours.
    assert time.process_time() - start < 10 * len(pages)


def brute(pages):
    """Texts by definition: hosts, mirrors, neighbours and lines of the site found page by page."""
    lines = [H.page_lines(h) for _, _, h in pages]
    host, path = zip(*((m[1].lower(), m[2]) if (m := re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")) else ("", "") for _, u, _ in pages), strict=True)
    plain = [[(t, k, f"{name}|{t}") for (p, name, t), k in zip(x, H.line_kinds(x), strict=True) if k] for x in lines]
    mirror = [(host[i], tuple((t, k, s if k == H.ARTICLE else "") for t, k, s in plain[i])) for i in range(len(pages))]
    first = {m: min((path[i], i) for i in range(len(pages)) if mirror[i] == m) for m in set(mirror)}
    texts = []
    for i in range(len(pages)):
        others = sorted((first[m][0], H.text_digest(lines[first[m][1]]), m) for m in first if m[0] == host[i])
        at = next(j for j, x in enumerate(others) if x[2] == mirror[i])
        before, after = (others[at - 1] if at else None), (others[at + 1] if at + 1 < len(others) else None)
        if not before and not after:
            own = [t for t, k, _ in plain[i] if k == H.ARTICLE]
            texts.append("\n\n".join(own or [t for t, _, _ in plain[i]]))
            continue
        near = before if H.nearest(others[at][0], before and before[0], after and after[0]) else after
        me = lines[first[mirror[i]][1]]
        shared = {sum(p != H.LANDMARK for p, _, _ in me[:x]) for x in H.common_lines(H.line_keys(me), H.line_keys(lines[first[near[2]][1]])) if me[x][0] != H.LANDMARK}
        gone = set()
        for x, (_, k, slot) in enumerate(plain[i]):
            have = sum(slot in {s for t, kind, s in plain[first[m][1]] if kind == H.ARTICLE} for *_, m in others)
            if x in shared and (k == H.BODY or have >= max(H.SITE_PAGES, H.SITE_SHARE * len(others))):
                gone.add(x)
        texts.append("\n\n".join(t for x, (t, _, _) in enumerate(plain[i]) if x not in gone))
    return texts


def test_whole_query_against_brute_force(pages_of, rows):
    r, pages = random.Random(8), []
    for i in range(240):
        # One host has a third of all pages; mirrors, shared paths, articles or none, site lines in and out of them.
        host, kind = r.choice(["big.com", "Mid.com", "s.com", f"h{r.randrange(20)}.com"]), r.randrange(3)
        body = "".join(f"<p class=c{r.randrange(2)}>{x}</p>" for x in r.sample([f"words {r.randrange(60)}", "a known line", "Read more", "Les."], r.randrange(1, 4)))
        body = f"<article>{body}<p class=more>All our stories</article>" if kind else f"<div>{body}</div>"
        pages.append((i, f"https://{host}/{r.choice('abc')}/{r.randrange(30)}?q={i}", f"<nav>{i}</nav><div>Welcome</div>{body}<span>foot</span><footer>{i}</footer>"))
    found = dict(rows(H.extracted(pages_of(pages)), "page_id", "text"))
    want = brute(pages)
    assert [found[i] for i, _, _ in pages] == want
    assert any("Welcome" not in t for t in want) and any("All our stories" in t for t in want) and any("All our stories" not in t for t in want)


def test_mirrors_and_odd_ids(pages_of, rows):
    one = lambda x: page(f"<p>{x}</p>")
    found = rows(H.extracted(pages_of([
        (1, "http://h/1", one("one")), (2, "http://h/2", one("dup")), (3, "http://h/3", one("dup")), (4, "http://h/4", one("dup")), (5, "http://h/5", one("two")),
        (6, None, "x"), (7, "x", None),
    ])), "page_id", "text")
    assert dict(found) == {1: "one", 2: "dup", 3: "dup", 4: "dup", 5: "two", 6: "x", 7: ""}


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
def test_given_articles_stay_whole(spark, rows):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    found = dict(rows(H.extracted(given), "page_id", "text"))
    for page_id, html in given.select("page_id", "html").collect():
        if article := told(html):
            assert found[page_id] == "\n\n".join(article)


def page(body, site="Welcome", article=False):
    inner = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    return f"<body><nav><a>{random.Random(body).random()}</a></nav><div>{site}</div>{inner}<div>All rights</div></body>"


def test_shared_lines_go_on_the_nearest_page_only(pages_of, rows):
    found = H.extracted(pages_of([
        (1, "http://h.com/a/1", page("<p>first</p><p>same word</p>")), (2, "http://h.com/a/2", page("<p>second</p><p>other</p>")),
        (3, "http://h.com/b/1", page("<p>third</p>", site="Elsewhere")), (4, "http://h.com/b/2", page("<p>fourth</p>", site="Elsewhere")),
        (5, "http://k.com/a/1", page("<p>alone</p>")), (6, "http://m.com/1", page("<p>own</p>", article=True)), (7, "http://m.com/2", page("<p>own</p>", article=True)),
        (8, "http://z.com/1", page("<p>mirror</p>")), (9, "http://z.com/2", page("<p>mirror</p>")),
    ]))
    text = {i: t for i, t, _ in rows(found, "page_id", "text", "n_chars")}
    assert text[1] == "first\n\nsame word" and text[2] == "second\n\nother" and text[3] == "third" and text[4] == "fourth"
    assert text[5] == "Welcome\n\nalone\n\nAll rights"  # no neighbour to learn from
    assert text[6] == text[7] == "own"  # a declared article is the page's own
    assert "mirror" in text[8] and "mirror" in text[9]


def test_differencing_decides_in_declared_articles(pages_of, rows, monkeypatch):
    article = lambda i, *more: page(f"<p>story {i}</p>" + "".join(f"<p>{x}</p>" for x in more), article=True)
    pages = pages_of(
        [(i, f"http://s.com/{i}", article(i, "Read more stories of ours", *(["a passage quoted once"] if i in (2, 3) else []))) for i in range(6)]
        + [(9, "http://one.com/", article(9, "Read more stories of ours"))]
        + [(i, f"http://mirror.com/{i}", article(7, "Read more stories of ours")) for i in range(20, 24)]
    )
    found = {i: t for i, t in rows(H.extracted(pages), "page_id", "text")}
    assert [found[i] for i in (0, 1, 4, 5)] == [f"story {i}" for i in (0, 1, 4, 5)]  # site lines go, in the article and beside it
    assert found[2] == "story 2\n\na passage quoted once" and found[3] == "story 3\n\na passage quoted once"
    # Nothing to be compared with: the declared article, whole.
    assert found[9] == "story 9\n\nRead more stories of ours" and {found[i] for i in range(20, 24)} == {"story 7\n\nRead more stories of ours"}
    monkeypatch.setattr(H, "common_lines", lambda a, b: [])
    assert {i for i, t in rows(H.extracted(pages), "page_id", "text") if t != found[i]} == set(range(6))


def test_odd_pages(pages_of, rows):
    long = "<article>" + "".join(f"<p>line {i}" for i in range(20_000)) + "</article>"
    found = rows(H.extracted(pages_of([
        (1, "http://a/x", None), (2, None, ""), (None, None, None), (3, "no host", "<p>x"), (3, "no host", "<p>x"), (4, "http://a/y", long), (5, "http://a/y", long),
    ])), "page_id", "text", "n_chars")
    assert len(found) == 7
    by = {i: (t, n) for i, t, n in found}
    assert by[1] == by[2] == by[None] == ("", 0) and by[3] == ("x", 1)
    assert by[4] == by[5] and by[4][0].startswith("line 0\n\nline 1\n\n") and by[4][1] == len(by[4][0])
    assert H.extracted(pages_of([])).count() == 0
