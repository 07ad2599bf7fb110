"""Whole pages enter the style tree, with the articles that they mark and their chrome."""

from ledgerloom.llm.site_style import extract, judged


def test_marked_articles_and_chrome_are_judged_by_the_tree(spark):
    page = lambda i: f"<body><nav><ul><li>Home</li><li>About us</li></ul></nav><article><h1>Title {i}</h1><p>Words of page {i}.</p><p>As ever.</p></article><div class='ad'>Buy {i}</div><footer>The site</footer></body>"
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", "a", page(i)) for i in range(40)], "page_id bigint, url string, host string, html string")
    texts, nodes = judged(pages.select("host", "html"))
    highest = {r.path: r.highest for r in nodes.collect()}
    assert {"/body/nav/ul/li", "/body/article/h1", "/body/article/p", "/body/div.ad", "/body/footer"} <= set(highest)
    assert max(highest["/body/footer"], highest["/body/nav"]) < 0.4 < highest["/body/article"]
    assert not any(r.open for r in texts.collect())
    # What recurs in a marked article stays by its prior, what varies in chrome goes by its own.
    assert {r.page_id: r.text for r in extract(pages).collect()} == {i: f"Title {i}\nWords of page {i}.\nAs ever." for i in range(40)}
