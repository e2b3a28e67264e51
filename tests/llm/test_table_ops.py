"""URL filters, licence scans, decontamination, HTML extraction, sharding and the pipeline."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keysnap.llm import html_text, licences, pii, quality, sharding, simhash, tiling, urls
from keysnap.llm import queries as Q
from keysnap.llm.common import table
from keysnap.llm.license_texts import LICENCES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


# URL filters


def brute_url(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for verdict, rule in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                          ("allow", "com/fr/"), ("block", "com/de/")):
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.train(spark, urls.labelled_urls())


def check_urls(rows, given):
    for r in rows:
        host, path = brute_url(given[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule = brute_rule(host, path)
        assert r["rule"] == (rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else r["learned"]) and r["verdict"] in ("allow", "block")


def test_url_query(spark):
    given = {r["page_id"]: r["url"] for r in table(spark, SF, "pages").collect()}
    rows = Q.QUERIES["op2_url_filter"](spark, SF).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(list(given))
    check_urls(rows, given)
    learned = {r["host"]: r["learned"] for r in rows}
    assert all(v == "block" for h, v in learned.items() if re.search("pills|spam|casino", h))
    assert sum(v == "block" for v in learned.values()) < len(learned) / 3


def test_urls_held_out(spark):
    rows = urls.labelled_urls()
    sites = sorted({re.sub(r"^(www|blog|m)\.|\.example.*", "", u[8:]) for u, _ in rows})
    held = set(sites[::6])
    inside = lambda u: any(s in u for s in held)
    model = urls.train(spark, [r for r in rows if not inside(r[0])])
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows) if inside(u)], "page_id long, url string")
    got = urls.judge_urls(pages, model, rules=()).collect()
    right = sum((r["learned"] == "block") == bool(rows[r["page_id"]][1]) for r in got)
    assert right / len(got) > 0.85


def test_odd_urls(spark, url_model):
    odd = [None, "", "no scheme", "://", "HTTP://A.Example.ORG/en/1x?y", "x://org", "x://org/", "x://corg/", "a://b://c/d",
           "x://www.Com/fr/a#b", "x://e.com?/fr/", "x://" + "a" * 20_000 + "/é", "x://é.ORG/\n/z", "x\n://m.org/q"]
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(odd)] + [(5, odd[5], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, features string")
    got = urls.judge_urls(pages, url_model).collect()
    assert len(got) == len(rows)
    check_urls(got, dict(enumerate(odd)))
    assert urls.judge_urls(pages.limit(0), url_model).count() == 0


def test_url_plan_is_native(spark):
    plan = Q.QUERIES["op2_url_filter"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Licences


def test_licence_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(Q.ORACLE_SQL["op3_licences"]).fetchall()
    got = [tuple(r) for r in Q.QUERIES["op3_licences"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[3] for r in got)


def test_licence_texts(spark):
    mit = dict(LICENCES)["MIT"]
    docs = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, mit.upper().replace(" ", "\n  ")), (3, mit + " more"),
        (4, None), (5, ""), (6, "Intro\nReleased under the MIT  Licence\nend"), (7, "!!!"), (7, "!!!"), (None, mit),
    ]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, licence string, digest string")
    got = [(r["doc_id"], r["licence"], r["notices"]) for r in licences.scan_licences(frame).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "MIT"), (7, None, ""),
         (7, None, ""), (None, "MIT", "")], key=repr)
    assert licences.scan_licences(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.known_digests(spark, [("a", "b")] * (licences.MAX_KNOWN + 1))


# Decontamination


def brute_tiles(item, doc, least):
    """Longest match first, by trying all."""
    a, b, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return tiles
        i, j, n = best
        a[i : i + n] = b[j : j + n] = [False] * n
        tiles.append(best)


def test_tiles_cover_as_greedy_search_does():
    import random

    rng = random.Random(7)
    for _ in range(60):
        item = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 50))]
        cuts = sorted(rng.sample(range(len(item) + 1), 3)) if len(item) > 8 else [0, 0, len(item)]
        pieces = [item[: cuts[0]], item[cuts[0] : cuts[1]], item[cuts[1] : cuts[2]], item[cuts[2] :]]
        rng.shuffle(pieces)
        doc = []
        for p in pieces:
            doc += [f"x{rng.randrange(9)}" for _ in range(rng.randrange(4))] + p
        got, want = tiling.tile(item, doc), brute_tiles(item, doc, 5)
        assert sum(n for *_, n in got) == sum(n for *_, n in want)
        for i, j, n in got:
            assert item[i : i + n] == doc[j : j + n] and n >= 5


def test_decontamination_query(spark):
    docs = {r["doc_id"]: tiling.tokenize(r["text"]) for r in table(spark, SF, "documents").collect()}
    items = {r["item_id"]: tiling.tokenize(r["text"]) for r in table(spark, SF, "benchmark").collect()}
    seeds = defaultdict(set)
    for k, t in items.items():
        for i in range(len(t) - 4):
            seeds[tuple(t[i : i + 5])].add(k)
    want = set()
    for d, t in docs.items():
        for k in {k for i in range(len(t) - 4) for k in seeds.get(tuple(t[i : i + 5]), ())}:
            if sum(n for *_, n in brute_tiles(items[k], t, 5)) >= 0.8 * len(items[k]):
                want.add((d, k))
    got = Q.QUERIES["op6_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0
    for r in got:
        for t in r["tiles"]:
            at, i, n = t["doc_start"], t["item_start"], t["length"]
            assert docs[r["doc_id"]][at : at + n] == items[r["item_id"]][i : i + n]


def test_an_item_at_the_end_of_a_very_long_document(spark):
    item = " ".join(f"word{i}" for i in range(40))
    text = "some other prose that goes on " * 60_000 + " ".join(item.split()[20:] + ["then"] + item.split()[:20])
    frame = spark.createDataFrame([(1, text), (2, text[:-400])], "doc_id long, text string")
    rows = tiling.find_contaminated(frame, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["covered_tokens"]) for r in rows] == [(1, 7, 40)]


def test_a_very_long_page(spark):
    paragraphs = [f"Paragraph {i} of a long story, told once." for i in range(60_000)]
    html = "<html><body><nav>Home News</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body></html>"
    page = spark.createDataFrame([(1, "http://h.org/x", html)], "page_id long, url string, html string")
    assert html_text.extract_text(page).first()["text"] == "\n\n".join(paragraphs)


def test_odd_documents_and_items(spark, monkeypatch):
    words = [f"word{i}" for i in range(30)]
    whole, turned = " ".join(words), " ".join(words[15:] + ["x"] + words[:15])
    docs = [(1, "a, b " + whole.upper() + "!"), (2, turned), (3, " ".join(words[:20])), (4, None), (5, ""), (2, turned),
            (None, whole), (6, "one two")]
    frame = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, item_id string, length long")
    items = spark.createDataFrame([(1, whole), (2, whole), (3, None), (4, ""), (5, "one two")], "item_id long, text string")
    for size in (tiling.BLOCK_BYTES, 10):  # all at once, and one block for each item
        monkeypatch.setattr(tiling, "BLOCK_BYTES", size)
        got = [(r["doc_id"], r["item_id"]) for r in tiling.find_contaminated(frame, items).collect()]
        assert sorted(got, key=repr) == sorted([(d, k) for d in (1, 2, 2, None) for k in (1, 2)], key=repr)
        clean = tiling.drop_contaminated(frame, items)
        assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]
    assert tiling.find_contaminated(frame, items.limit(0)).count() == 0
    assert tiling.find_contaminated(frame.limit(0), items).count() == 0


# HTML


def test_html_query(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    rows = Q.QUERIES["op7_html"](spark, SF).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(list(pages))
    from html import unescape

    for r in rows:
        page = pages[r["page_id"]]
        inner = page["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"]) and r["url"] == page["url"]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="post">
    <header><h1>Site</h1></header><div id="cookie-notice">We use <b>cookies</b></div><nav><ul><li>Home<li>About</ul></nav>
    <article><header><h1>Title &amp; more</h1></header><p>One <i>t</i>wo&nbsp;three<p>Four<br>five
    <div class="ad"><div>Buy</div>now</div><p title="a > b">x &lt; y<!-- <p>no</p> --></p><script>"</article>"</script>
    <ul><li>i<li>ii</ul><section class="comments"><p>nice</p></section></article>
    <aside>side</aside><form><p>mail</p></form><p hidden>secret</p><footer>end</footer>"""
    main = [t for k, t in html_text.blocks(page) if k == html_text.ARTICLE]
    assert main == ["Title & more", "One two three", "Four five", "x < y", "i", "ii"]
    assert html_text.blocks(None) == html_text.blocks("") == []
    assert [t for _, t in html_text.blocks("a < b <!-- open")] == ["a < b"]
    assert [t for _, t in html_text.blocks("<p>x<script>never closed <p>y")] == ["x"]
    assert [t for _, t in html_text.blocks("<p>&eacute;&#x41;&copy x</p></div></p>")] == ["éA© x"]


def brute_unmarked(pages):
    """Tokens under a prefix that another page of the host has go."""
    read = {i: (html_text.host_of(u), html_text.blocks(h)) for i, (u, h) in pages.items()}
    keys = defaultdict(set)
    own = {}
    for i, (host, found) in read.items():
        if any(k == html_text.ARTICLE for k, _ in found):
            every = [t.split() for _, t in found if _ != html_text.ARTICLE]
            mine = html_text.prefixes(every, [False] * len(every))
        else:
            opened = [t.split() for k, t in found if k == html_text.OPEN]
            marked = [t.split() for k, t in found if k == html_text.DROP]
            mine = html_text.prefixes(opened, [True] * len(opened)) | html_text.prefixes(marked, [False] * len(marked))
        for k in mine:
            keys[host, k].add(i)
    for i, (host, found) in read.items():
        main = [t for k, t in found if k == html_text.ARTICLE]
        opened = [t for k, t in found if k == html_text.OPEN]
        repeated = {k for (h, k), pages_ in keys.items() if h == host and len(pages_) > 1}
        own[i] = "\n\n".join(main or html_text.unique_runs(opened, repeated))
    return own


def test_unmarked_pages(spark):
    bar = "Home News Sport Weather Travel Contact us today"
    pages = {
        i: (f"http://h{i % 2}.org/{i}", f"<div><span>{bar}</span></div><div>{bar} Story {i} tells of number {i * i} and ends."
            f"</div><p>Only here {i}</p><div>All rights reserved by the owner of this site</div>")
        for i in range(24)
    }
    pages |= {90: (None, f"<p>{bar}</p>"), 91: ("http://h0.org", None), 92: ("x", ""), 93: ("http://alone.org/", f"<p>{bar}"),
              94: ("http://h1.org/q", f"<nav>{bar}</nav><article><p>{bar}</p></article>")}
    rows = [(i, u, h, "x", 7) for i, (u, h) in pages.items()]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row long").repartition(6)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    assert got == brute_unmarked(pages)
    assert got[3] == "3 tells of number 9 and ends.\n\nOnly here 3"  # "Story" follows the bar everywhere
    assert got[93] == bar and got[94] == bar and got[91] == got[92] == ""
    assert html_text.extract_text(frame.limit(0)).count() == 0


# Sharding


def check_shards(rows, texts, shards=40):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = Q.QUERIES["op9_sharding"](spark, SF).collect()
    check_shards(rows, texts)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    # A boundary between shards cuts one group at most.
    assert sum(len(s) - 1 for s in where.values()) < 40


def test_shards_of_a_hot_group(spark):
    texts = {i: "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 2 else None if i == 10 else "" if i == 14 else f"t{i}"
             for i in range(500)}
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts.items()],
                                  "doc_id long, text string, group string, row long, label int")
    rows = sharding.assign_shards(frame.repartition(7)).collect()
    check_shards(rows, texts)
    hot = Counter(r["shard"] for r in rows if texts[r["doc_id"]] == "hot")
    assert len(hot) <= 20  # at least 13


@pytest.mark.parametrize("n", [0, 1, 39, 41])
def test_few_documents(spark, n):
    frame = spark.createDataFrame([(i, "same") for i in range(n)], "doc_id long, text string")
    check_shards(sharding.assign_shards(frame).collect(), {i: "same" for i in range(n)})


def test_repeated_rows_are_sharded_apart(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = sharding.assign_shards(frame, shards=2).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [1, 2]


# Pipeline


def test_pipeline_against_its_parts(spark):
    """Stage by stage with plain Python on the collected rows."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = docs
    given = [r.asDict() for r in docs.collect()]
    rules = None
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, SF)
        if name == "packing":
            assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in given}
            break
        after = after.cache()
        rows = [r.asDict() for r in after.collect()]
        assert after.columns == columns
        if name == "quality_rules":
            stats = quality.with_stats(docs, keep=["doc_id"]).cache()
            rules = quality.fit_rules(stats, table(spark, SF, "labels"))
            want = {r["doc_id"] for r in quality.judged(stats, rules).where("kept").collect()}
        elif name == "simhash_near_dedup":
            from test_near_copies import brute_kept

            want = brute_kept({r["doc_id"]: r["text"] for r in given})
        elif name == "benchmark_decontamination":
            index = tiling.Index([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])
            want = {r["doc_id"] for r in given if not list(index.held(r["text"]))}
        else:
            want = {r["doc_id"] for r in given}
            texts = {r["doc_id"]: pii.mask_text(r["text"]) for r in given}
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows} == {d: (t, len(t)) for d, t in texts.items()}
        assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        given, kept = rows, after


def test_pipeline_keeps_clean_documents(spark):
    rows = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    kept = {r["doc_id"] for r in rows}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(kept & good) / len(good) > 0.75 and len(kept) < 1000


def test_stages_with_odd_rows(spark):
    odd = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "short", "en", "s", 5), (None, "no id " * 3, "en", "s", 1)]
    odd += [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "s", 9) for i in (5, 5, 6)] + [(9, "word " * 20_000, "de", "s", 1)]
    frame = spark.createDataFrame(odd, table(spark, SF, "documents").schema)
    for some in (frame, frame.limit(0)):
        docs = some
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert sorted(r["doc_id"] for r in docs.select("doc_id").distinct().collect()) == ([] if some is not frame else [5, 6])


def test_stages_with_clashing_columns(spark):
    """Extra columns come through, whatever they are called."""
    docs = table(spark, SF, "documents")
    extra = docs.withColumns({c: F.lit(c) for c in ("row", "fp", "n_words", "kept", "rule", "stays", "masked", "id", "rank", "c0")})
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        extra, plain = stage(spark, extra, SF), stage(spark, plain, SF)
        assert extra.columns[:5] == docs.columns and len(extra.columns) == 15
        assert extra.where("row <> 'row' or n_words <> 'n_words' or c0 <> 'c0'").isEmpty()
        plain, extra = plain.cache(), extra.cache()
        assert sorted(map(tuple, extra.select(docs.columns).collect())) == sorted(map(tuple, plain.collect()))
