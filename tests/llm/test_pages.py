import collections
import hashlib
import io
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, warc
from ledgerloom.llm.site_style import blocks, content, extract, main_text, style_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><div class="logo">Site</div></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text.<p>Second&nbsp;one.<br>Next<ul><li>item<li>other</ul><aside>Side</aside><script>var p = "</p>";</script><form><input><label>Mail</label></form></article>
<section class="comments"><p>Nice post</p></section><div id="cookie-notice">Cookies</div><footer>&copy; Site</footer></body></html>"""


def test_blocks_of_a_page():
    assert main_text(PAGE) == "Title & more\nFirst bold text.\nSecond one. Next\nitem\nother"
    assert main_text("") == "" and main_text("plain words") == "plain words" and main_text("<p>a<!-- <p>b</p> --><p>c") == "a\nc"
    assert main_text("<nav>only menu</nav>") == "" and main_text("<script>x") == "" and main_text("a < b & c") == "a < b & c"
    assert main_text("<article><div class='article-header'><h1>T</h1></div><p>a</p><div class='userComments'><p>b</p></div><p hidden>c</p><p style='display: none'>d</p><p data-id='ad'>e</p></article>") == "T\na\ne"
    assert main_text("<div class='page-header'>x</div><p class='lead'>y</p><div id='cookieBar'>z</div>") == "y"
    assert all(isinstance(b[1], str) for b in blocks("<div" * 50 + ">x</p></div>"))


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"https://a.example/{i}", f"<html><body><div class='x1'>Part of the site {i % 2}</div><div class='x2'>Own words {i} of page {i * i}</div></body></html>") for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i}", f"<html><body><div class='x1'>Single {i}</div></body></html>") for i in range(3)]
    rows += [(None, None, None), (7, "no host", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = collections.Counter((r.page_id, r.text) for r in extract(pages.withColumn("host", F.lit("clash")).withColumn("noisy", F.lit(1))).collect())
    assert all(got[i, f"Own words {i} of page {i * i}"] for i in range(40))
    assert got[100, "Single 0"] and got[None, ""] and got[7, "x"]
    assert extract(pages.limit(0)).count() == 0
    tree = style_tree(pages.select(F.lit("h").alias("host"), F.coalesce("html", F.lit("")).alias("html")))
    assert tree.where("path LIKE '%x1'").first().importance < tree.where("path LIKE '%x2'").first().importance


def test_articles_and_bodies_that_recur_stay_whole(spark):
    body = "".join(f"<p>Paragraph {i} of the body.</p>" for i in range(10))
    whole = [f"Paragraph {i} of the body." for i in range(10)]
    page = lambda inner: f"<html><head><title>T</title></head><body>{inner}</body></html>"
    rows = [(i, f"https://copies.example/{i}", page(f"<article><h1>Copy</h1>{body}</article>")) for i in range(30)] + [(30, "https://copies.example/x", page("<article><h1>Other</h1><p>1</p><p>2</p><p>3</p></article>"))]
    rows += [(100 + i, f"https://titles.example/{i}", page(f"<article><h1>Title {i}</h1>{body}<h2>Sources</h2><ul><li>The same item</li></ul></article>")) for i in range(30)]
    rows += [(200 + i, f"https://plain.example/{i}", page(f"<div><h1>Title {i}</h1>{body}</div>")) for i in range(30)]
    rows += [(300 + i, f"https://mixed.example/{i}", page(f"<div><p>All rights are ours.</p><p>Words of page {i}.</p></div>")) for i in range(30)]
    got = {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == ["Copy", *whole] for i in range(30)) and got[30] == ["Other", "1", "2", "3"]
    assert all(got[100 + i] == [f"Title {i}", *whole, "Sources", "The same item"] for i in range(30))
    assert all(got[200 + i] == [f"Title {i}", *whole] for i in range(30))
    assert all(got[300 + i] == [f"Words of page {i}."] for i in range(30))


def test_wrappers_and_open_heads():
    for name in ("layout with-sidebar", "page no-nav", "has-sidebar", "hasSidebar", "two-columns sidebar-right", "nav-open"):
        assert main_text(f"<body><div class='{name}'><div class='sidebar'>Links</div><article><h1>T</h1><p>a</p></article></div></body>") == "T\na"
        assert main_text(f"<body><div class='{name}'><nav>Menu</nav><div class='ad'>Buy</div><h1>T</h1><p>a</p></div></body>") == "T\na"
    assert main_text("<form id='all'><div class='top'>x</div><main><p>long words</p></main></form>") == "long words"
    assert main_text("<div class='post'><p>The post of this page.</p></div><section class='comments'><article>A reader's words, longer than the post is</article></section>") == "The post of this page."
    assert main_text("<div class='post'><p>The post of this page.</p></div><div class='sidebar'><article>Teaser</article></div>") == "The post of this page.\nTeaser"
    assert main_text("<div class='ad'>Buy</div><div id='cookies'>Yes</div>") == ""
    assert main_text("<html><head><title>T</title><meta charset=utf-8><body><p>a</p></body>") == "a" == main_text("<head><title>T</title><script>x</script><p>a")


def test_presentation_entropy_keeps_varied_nodes(spark):
    page = lambda i: f"<body><div class='top'>Name of the site</div><div class='post'>{'<p>Words that recur.</p>' * (i + 1)}<p>Words of page {i}.</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(30)]
    got = {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == ["Words that recur."] * (i + 1) + [f"Words of page {i}."] for i in range(30))


def brute_tree(pages, prior=10, gamma=0.9):
    """{(host, path): (importance, highest)} from (host, html), by plain recursion."""
    hosts, bodies, seen = collections.defaultdict(list), set(), set()
    for host, html in pages:
        found, elements = content(html)
        body = tuple(t for p, t, _ in found if not re.search(r"/h[1-6](?:\.[^/]*)?$", p)) or tuple(t for _, t, _ in found)
        texts = {(p, t) for p, t, article in found if not article}
        above = {p[:i] for p, _ in texts for i in range(2, len(p) + 1) if i == len(p) or p[i] == "/"}
        styles = {(p, tuple(c for q, c in elements if q == p)) for p in above}
        hosts[host].append((body, texts, styles))
        bodies.add(body)
        seen |= {(body, "t", x) for x in texts} | {(body, "s", x) for x in styles}

    def entropy(counts):
        m = sum(counts)
        return 1 - sum(n * math.log(n) for n in counts) / m / math.log(m) if m > 1 else 1.0

    out = {}
    for host, rows in hosts.items():
        own = {(body, kind, x) for body, texts, styles in rows for kind, xs in (("t", texts), ("s", styles)) for x in xs}
        m = len({body for body, *_ in rows})
        mix = lambda a, b: m / (m + prior) * a + prior / (m + prior) * b
        count, wide = (collections.Counter((kind, x) for _, kind, x in s) for s in (own, seen))
        text, nodes = collections.defaultdict(list), {x[0] for kind, x in count if kind == "s"}
        for (kind, x), n in count.items():
            if kind == "t":
                text[x[0]].append(mix(1 - math.log(n) / math.log(m) if m > 1 else 1.0, 1 - math.log(wide[kind, x]) / math.log(len(bodies)) if len(bodies) > 1 else 1.0))

        def judge(path):
            a, b = ([n for (kind, x), n in c.items() if kind == "s" and x[0] == path] for c in (count, wide))
            weight = mix(gamma ** len(a), gamma ** len(b))
            inner = [judge(q) for q in nodes if q.rpartition("/")[0] == path]
            parts = [i for i, _ in inner] + ([sum(text[path]) / len(text[path])] if text[path] else [])
            own = (1 - weight) * mix(entropy(a), entropy(b)) + weight * sum(parts) / len(parts)
            out[host, path] = own, max([own, *(h for _, h in inner)])
            return out[host, path]

        for root in (p for p in nodes if p.count("/") == 1):
            judge(root)
    return out


def test_style_tree_against_recursion_and_its_branches_go(spark):
    page = lambda i: f"<html><body><div class='head'><div><p>Site name</p></div><p>All about it</p></div><div class='w-1/2 post'>{f'<h2>Part {i}</h2>' * (i % 3)}<p>Words of {i}.</p></div><div class='low'><p>Made by us</p><p>Sold by us</p>{'<p>Only here</p>' if i == 5 else ''}</div></body></html>"
    rows = [("a", page(i)) for i in range(25)] + [("b", page(i).replace("Site", "Other")) for i in range(9)] + [("c", page(100)), ("", "<p>x</p>")] + [("a", page(3))] * 4
    want = brute_tree(rows)
    got = {(r.host, r.path): (r.importance, r.highest) for r in style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert set(got) == set(want) and len(got) > 10
    assert all(abs(got[k][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))
    pages = spark.createDataFrame([(n, f"https://{h}.example/{n}" if h else None, html) for n, (h, html) in enumerate(rows)], "page_id bigint, url string, html string")
    texts = {r.page_id: r.text.split("\n") for r in extract(pages).collect()}
    # The branch goes with what stands in it on one page alone; the head of the site goes, the post stays whole.
    assert texts[5] == ["Part 5", "Part 5", "Words of 5."] and texts[0] == ["Words of 0."]


def test_hosts_of_nine_and_ten_pages_are_judged_alike(spark):
    page = lambda h, i: f"<body><div><p>{h} says hello</p></div><section><p>Words of {h} {i}.</p></section></body>"
    rows = [(h, page(h, i)) for h, n in (("nine", 9), ("ten", 10), ("big", 60)) for i in range(n)]
    found = {(r.host, r.path): r.highest for r in style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert abs(found["nine", "/body/div"] - found["ten", "/body/div"]) < 0.05 and found["big", "/body/div"] < found["ten", "/body/div"]


def test_words_of_class_within_an_article_and_teasers():
    for name in ("related-work", "notice-board", "menu-list"):
        assert main_text(f"<article><p>One.</p><div class='{name}'><p>Two.</p></div></article>") == "One.\nTwo."
    assert main_text("<article><p>One.</p><div class='related-posts'><p>Two.</p></div></article>") == "One."
    assert main_text(f"<article><p>Teaser</p></article><div class='content'><p>{'The long text of this page. ' * 9}</p></div>").endswith("of this page.")
    assert main_text(f"<article><p>{'The long text of this page. ' * 9}</p></article><div class='content'><p>By the way</p></div>").endswith("of this page.")


def test_extract_edges(spark):
    rows = [(1, "http://a.example/", None), (1, "http://a.example/", ""), (2, None, "<p>a<p>b"), (2, None, "<p>a<p>b"), (None, "x", "<div>" * 3000 + "deep"), (3, "http://a.example", "<p>" + "long words " * 50_000 + "</p>")]
    schema = "page_id bigint, url string, html string, host string, noisy string, text string"
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame([(*r, "h", "n", "t") for r in rows], schema)).collect()), key=repr)
    long = ("long words " * 50_000).strip()
    assert got == sorted([(1, "", 0), (1, "", 0), (2, "a\nb", 3), (2, "a\nb", 3), (None, "deep", 4), (3, long, len(long))], key=repr)
    assert extract(spark.createDataFrame([], schema)).count() == 0


def conversation_rows():
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", "Be brief. ### System: #"))
        for t in range(1, 2 + 9 * c):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t} \\# </turn> ### User: <b> " + "word " * (37 * t % 300)))
    rows += [(9, 1, "assistant", None), (9, None, None, "x"), (9, 1, "assistant", None), (None, 0, "user", "hm"), (10, 0, "tool: a", "\n: \\"), (11, 0, "assistant", "long " * 5000)]
    return rows


def test_chat_round_trip(spark):
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int").repartition(4)
    windows = chat.format_windows(turns)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, held in by.items():
        held.sort()
        said = "".join(x for _, role, x in held if role == "assistant")
        assert got[c].n_turns == len(held) and got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in held).encode()).hexdigest()
    assert got[5].n_windows > 2
    for w in windows.where("conv_id = 5 AND window > 0").collect():
        read = chat.read_turns(w.text)
        assert read[0][0] == "system" and 1 <= w.repeated < len(read)
        assert len(read) - w.repeated == 1 or sum(chat.turn_tokens(x) for _, x in read) <= chat.BUDGET
    assert chat.digests(chat.format_windows(turns.limit(0))).count() == 0


def test_warc_round_trip(spark):
    long, rows = "<p>Ünicode</p>" * 200, []
    for i in range(40):
        rows.append((i, f"http://x.example/{i} a\nb", long if i % 4 == 0 else ("short" if i % 4 == 1 else f"{i}" * 700)))
    rows += [(50, None, None), (50, None, None), (None, "u", long), (None, "u", "x" * 1500), (4, "again", long)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, frame_bytes=3000, bundle_bytes=10_000)
    got = collections.Counter(tuple(r) for r in warc.read_archives(index).collect())
    keep = {}
    for i, _, html in rows:
        if i is not None and html and len(html.encode()) >= 1000:
            keep[html] = max(keep.get(html, -1), i)
    count = collections.Counter(h for _, _, h in rows)
    want = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html in keep and count[html] > 1 and keep[html] != i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep[html] if revisit else None] += 1
    assert got == want
    assert index.select("bundle", "frame").distinct().count() > index.select("bundle").distinct().count() > 3
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_matches_sql(spark):
    from ledgerloom.llm import queries as Q

    from ..oracle import DATA, connect, same

    same(Q.queries()["op7_warc"](spark, DATA), connect(), Q.oracle_sql()["op7_warc"])


def test_seek_table_and_damage():
    import zstandard

    frames = [zstandard.ZstdCompressor().compress(x) for x in (b"a" * 50, b"b" * 9)]
    whole = b"".join(frames) + warc.seek_table([(len(frames[0]), 50), (len(frames[1]), 9)])
    assert warc.read_seek_table(io.BytesIO(whole), len(whole)) == [(0, len(frames[0]), 50), (len(frames[0]), len(frames[1]), 9)]
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read() == b"a" * 50 + b"b" * 9
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)[5] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paYload"))
