"""What a host's repeats take from unmarked pages, and what they leave."""

from keysnap.llm import html_text

COLUMNS = "page_id long, url string, html string"


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], COLUMNS).repartition(4)
    return [r["text"] for r in sorted(html_text.extract_text(frame).collect(), key=lambda r: r["page_id"])]


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_repeats(spark):
    notice, bar = words("notice", 50), words("bar", 8)
    heading = ("http://a.org/1", f'<h1 class="entry-title">Title</h1><div>{words("body", 30)}</div>')
    copies = [("http://b.org/1", f"<div>{words('copied', 20)}</div>")] * 2
    # The notice begins inside the block, and only marked pages have it besides.
    footers = [("http://c.org/1", f"<article><p>{words('x', 9)}</p></article><footer>Our {notice}</footer>"),
               ("http://c.org/2", f"<p>{words('own', 12)}</p><p>{notice}</p>")]
    large = [("http://d.org/", f"<div>{bar}</div><div>{words(f'p{i}q', 20)} {'one same phrase of six words' if i < 4 else ''}</div>")
             for i in range(40)]
    long = [("http://e.org/", f"<p>{words(f'e{i}f', 9)}</p><p>{notice if i < 2 else words(f'z{i}', 9)}</p>") for i in range(20)]
    got = texts(spark, [heading, *copies, *footers, *large, *long])
    assert got[0] == f"Title\n\n{words('body', 30)}"
    assert got[1:3] == [words("copied", 20)] * 2
    assert got[3:5] == [words("x", 9), words("own", 12)]
    for i in range(40):
        assert got[5 + i] == f"{words(f'p{i}q', 20)}{' one same phrase of six words' if i < 4 else ''}"
    assert got[45] == words("e0f", 9) and got[46] == words("e1f", 9)


def test_a_marked_heading_is_no_article():
    page = '<h1 class="entry-title">Title</h1><p class="post-date">May</p><div>Body</div>'
    assert html_text.blocks(page) == [(html_text.OPEN, x) for x in ("Title", "May", "Body")]
    assert html_text.blocks('<div class="entry"><h1>T</h1></div>') == [(html_text.ARTICLE, "T")]


def test_blocks_that_a_hosts_articles_repeat(spark):
    ask, quote = "Subscribe to us today", words("quoted", 40)
    page = lambda host, i, *blocks: (f"http://{host}/{i}", f"<nav>n{i}</nav><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>")
    site = [page("a.org", i, words(f"a{i}b", 5), ask, *([quote] if i < 3 else []), f"{ask} or {i}") for i in range(7)]
    site += [page("a.org", 7, ask), page("a.org", 8, words("own", 5))]
    few = [page("b.org", i, words(f"b{i}c", 5), ask) for i in range(3)]
    same = [page("c.org", i, ask, quote) for i in range(6)]
    got = texts(spark, [*site, *few, *same])
    for i in range(7):
        assert got[i] == "\n\n".join([words(f"a{i}b", 5), *([quote] if i < 3 else []), f"{ask} or {i}"])
    assert got[7:9] == [ask, words("own", 5)]
    assert got[9:12] == [f"{words(f'b{i}c', 5)}\n\n{ask}" for i in range(3)]
    assert got[12:] == [f"{ask}\n\n{quote}"] * 6
