"""Operator 5: main text of pages by a site style tree.

The DOMs of a host's pages are merged into a tree whose nodes are style paths (tags with their classes, from the root).

* Content: a text at a node has the importance 1 - log n / log m, if n of the host's m bodies have it there. Pages of equal body,
  whatever their headings and chrome, count once.
* Presentation: a node's style on a page is the sequence of its elements there, each with the tags and classes of its children. Its
  importance is the entropy of these styles over the bodies that have the node, as a share of the most possible.
* Composite importance of a node with l styles: (1 - GAMMA ** l) of its presentation and GAMMA ** l of the mean of its children,
  the texts that stand in the node itself being one of them.

A branch whose node and descendants all are of low composite importance is removed from each page, with all that stands in it;
elsewhere a text goes if it is of low importance itself and its node's presentation doesn't save it. What a host says is blended with
what all hosts say, by m / (m + PRIOR_PAGES), so that hosts of few bodies are judged by the others, without a step.

The tree is of whole pages: marked articles, chrome and all between enter it and are judged. A prior is then added to the importance of a
text, as its place on the page says. Menus, notices and the like that vary from page to page, reader comments above all, no entropy tells
from an article: tags and words of class, which a wrapper of the article overrides, take 1 from it, as a marked article does from
what stands beside it, unless longer text stands there. Text within a marked article gains 1, so what recurs there stays.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

MIN_IMPORTANCE, PRIOR_PAGES, GAMMA = 0.4, 10, 0.9
#: Elements below this depth belong to their ancestor there.
MAX_DEPTH = 40
#: Up to this many noisy texts and branches are broadcast to the scan; more are joined by host with a shuffle, each host in SALTS parts.
BROADCAST_TEXTS, SALTS = 200_000, 16

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|select|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w=\"'-])hidden(?![\w-])|display\s*:\s*none", re.I)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FORMS = frozenset("form fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
#: Words of class, id and role that mark chrome anywhere, and those that do outside of an article only.
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsbygoogle|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent\w*|gdpr|notices?|popup\w*|modal\w*|nav\w*|menus?\w*|breadcrumbs?|sidebar\w*|comments?\w*|replies|respond|disqus|"
    r"share|sharing|social\w*|related\w*|recommended\w*|newsletter\w*|subscribe\w*|signup|pagination|pager|widget\w*|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Within an article a whole class must say so: related-work or menu-list may be the article's own.
_CHROME_INSIDE = re.compile(
    r"(?:^|\s)(?:(?:ads?|advert(?:isement)?)(?:[-_](?:slot|unit|box|banner|container|wrapper))?|adsbygoogle|sponsored|promo(?:[-_](?:box|banner))?|cookies?(?:[-_](?:notice|banner|bar))?|gdpr|notices?|popup|modal|"
    r"nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|(?:(?:user|reader|post|article)[-_])?comments?(?:[-_](?:list|section|area|form|thread|body))?|replies|respond|disqus(?:[-_]thread)?|(?:share|sharing|social)(?:[-_](?:bar|buttons?|links?|icons?|share|media))?|"
    r"(?:related|recommended)(?:[-_](?:posts?|articles?|links?|stories|content))?|newsletter(?:[-_](?:signup|form|box))?|subscribe|signup|pagination|pager|widget|toolbar|complementary|contentinfo)(?=$|\s)",
    re.I,
)
_CHROME_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header\w*|footer\w*|masthead|alert\w*|side|login|search\w*|tags?|skip|top-?bar|logo)(?:$|[\s_-])", re.I)
#: Class words that tell a layout's columns (with-sidebar, no-nav), not what the element is.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|without|has|have|no|show|hide)[-_]\S*", re.I)
#: Chrome whose own articles, as of readers or teasers, are not the page's.
_OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?\w*|replies|respond|disqus|related\w*|recommended\w*|promo\w*|sponsor\w*|ads?|advert\w*)(?:$|[\s_-])", re.I)
#: Elements that a page has once, as a frame of the whole: what holds one is no single notice or menu.
_PAGE_MARKS = frozenset("h1 header nav footer aside".split())
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _scan(page: str) -> tuple[list[tuple], list[tuple], list[dict]]:
    """Blocks (style path, text, hard chrome, within an article, class-word wrappers around), elements (style path,
    tags and classes of the children, and as of blocks) and wrappers of a page, in order."""
    out, elements, wrappers, stack, held, at = [], [], [], [], [], 0

    def state() -> tuple:
        return stack[-1][1:] if stack else ("", False, False, (), None)

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            path, hard, article, wraps, _ = state()
            out.append((path, text, hard, article, wraps))

    def pop(tags) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in ("article", "main", "section", "div", "td", "ul", "ol", "table", "body") and tags is not _CLOSES_P:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1):
                held.append(" ")
            continue
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            continue
        flush()
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in _SIBLINGS:
            pop(_SIBLINGS[tag])
        if tag in _VOID or tag == "head" or m.group(4).endswith("/"):
            continue
        path, hard, article, wraps, children = state()
        names = " ".join(sorted({x for n in _NAMES.finditer(m.group(4)) if n[1].lower() != "id" for x in (n[2] or n[3] or n[4] or "").split()}))
        every = " ".join((n[2] or n[3] or n[4] or "") for n in _NAMES.finditer(m.group(4))) if m.group(4) else ""
        for w in wraps:
            wrappers[w]["article"] |= tag == "main" or (tag == "article" and not wrappers[w]["others"])
            wrappers[w]["mark"] |= tag in _PAGE_MARKS
        hard = hard or (tag in _CHROME_TAGS and tag not in _FORMS) or (tag == "header" and not article)
        soft, others = tag in _FORMS, False
        if not hard and m.group(4).strip() and tag not in ("html", "body", "article", "main"):
            said = _LAYOUT.sub(" ", _CAMEL.sub("-", every))
            hard = bool(_HIDDEN.search(m.group(4)))
            soft = soft or bool(_CHROME_INSIDE.search(said) if article else _CHROME.search(said) or _CHROME_OUTSIDE.search(said))
            others = bool(_OTHERS.search(said))
        if soft:
            wrappers.append({"article": False, "mark": False, "others": others})
            wraps = (*wraps, len(wrappers) - 1)
        name = f"{tag}{'.' + names.replace(' ', '.') if names else ''}".replace("/", "|")
        if children is not None:
            children.append(name)
        stack.append((tag, f"{path}/{name}" if path.count("/") < MAX_DEPTH else path, hard, article or tag in ("article", "main"), wraps, []))
        elements.append(stack[-1][1:])
    if at < len(page):
        held.append(page[at:])
    flush()
    return out, [(path, " ".join(children), hard, article, wraps) for path, hard, article, wraps, children in elements], wrappers


def _cleared(found: list[tuple], wrappers: list[dict]) -> tuple[frozenset[int], bool]:
    """Class-word wrappers that the page overrides, and whether its article is then all that is read.

    Without an article in sight, wrappers of an article are cleared, where the fewest stand around one; if no text were
    left, those that hold the frame of a page. Text in sight that is longer than the articles found, then teasers, stays beside them.
    """
    found = [b for b in found if not b[2]]
    seen = [b for b in found if not b[4]]
    if any(b[3] for b in seen) or not wrappers:
        inside = sum(len(b[1]) for b in seen if b[3])
        return frozenset(), inside > 0 and 2 * inside >= sum(len(b[1]) for b in seen)
    for may in ([b for b in found if b[3] and all(wrappers[w]["article"] for w in b[4])], [] if seen else [b for b in found if all(wrappers[w]["mark"] for w in b[4])]):
        if may:
            few = min(len(b[4]) for b in may)
            clear = frozenset(w for b in may if len(b[4]) == few for w in b[4])
            shown = [b for b in found if clear.issuperset(b[4])]
            inside = sum(len(b[1]) for b in shown if b[3])
            return clear, inside > 0 and inside >= sum(len(b[1]) for b in seen)
    return frozenset(), False


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(style path, text, within chrome, within an article) of each block of a page, in order."""
    found, _, wrappers = _scan(page)
    clear, _ = _cleared(found, wrappers)
    return [(path, text, hard or not clear.issuperset(wraps), article) for path, text, hard, article, wraps in found]


#: What a block's place adds to the importance of its text.
CHROME, OPEN, ARTICLE = -1, 0, 1


def whole(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """(style path, text, prior) of all blocks of a page, and (style path, children) of all its elements."""
    found, elements, wrappers = _scan(page)
    clear, only = _cleared(found, wrappers)
    prior = lambda hard, article, wraps: CHROME if hard or not clear.issuperset(wraps) or (only and not article) else ARTICLE if article else OPEN
    return [(path, text, prior(hard, article, wraps)) for path, text, hard, article, wraps in found], [(path, children) for path, children, *_ in elements]


def content(page: str) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """(style path, text, within an article) of the blocks without a prior against them, and the elements of ``whole``."""
    found, elements = whole(page)
    return [(path, text, prior == ARTICLE) for path, text, prior in found if prior != CHROME], elements


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _branches(path: str) -> list[str]:
    """The style paths of a node's ancestors and its own."""
    return [path[:i] for i, c in enumerate(path) if c == "/" and i] + [path]


def main_text(page: str, noisy: frozenset[int] = frozenset()) -> str:
    """Blocks that stay, joined by line feeds; ``noisy`` has the hashes of texts at their paths and of branches. If these were all
    of the page, they are kept."""
    found = [block for block in whole(page)[0] if block[2] != CHROME]
    gone = {path: any(_hash(b) in noisy for b in _branches(path)) for path in {path for path, _, prior in found if prior == OPEN}} if noisy else {}
    kept = [text for path, text, prior in found if prior == ARTICLE or not noisy or not (gone[path] or _hash(path, text) in noisy)]
    return "\n".join(kept or [text for _, text, _ in found])


PAGE, TEXT, STYLE = 0, 1, 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, kind, path, feature, hash of the body, whether without a prior) once for each page: the page itself, hashes of all its texts at
    their paths, and of the presentation of the nodes above these. The body is what has no prior against it."""
    for batch in slices(batches, "html"):
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, elements = whole(page)
            shown = [(path, text) for path, text, prior in found if prior != CHROME]
            body = _hash(*([text for path, text in shown if not _HEADING.search(path)] or [text for _, text in shown]))
            rows.append((host, PAGE, "", 0, body, False))
            texts: dict[tuple[str, str], bool] = {}
            for path, text, prior in found:
                texts[path, text] = texts.get((path, text), False) or prior == OPEN
            rows += [(host, TEXT, path, _hash(path, text), body, is_open) for (path, text), is_open in texts.items()]
            styles = {b: [] for b in {b for path in {path for path, _ in texts} for b in _branches(path)}}
            for path, children in elements:
                if path in styles:
                    styles[path].append(children)
            rows += [(host, STYLE, path, _hash(path, *children), body, False) for path, children in styles.items()]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "kind", "path", "feature", "body", "open"])


def _presentation(counts: DataFrame, *node: str) -> DataFrame:
    """The nodes with ``entropy``, that of their presentations as a share of the most possible, and ``weight``, GAMMA to the number of these."""
    sums = counts.groupBy(*node).agg(F.sum("n").alias("__m"), F.sum(F.col("n") * F.log("n")).alias("__s"), F.count("*").alias("__l"))
    entropy = F.when(F.col("__m") > 1, 1 - F.col("__s") / F.col("__m") / F.log("__m")).otherwise(1.0)
    return sums.select(*node, entropy.alias("entropy"), F.pow(F.lit(GAMMA), F.col("__l")).alias("weight"))


def _blend(own, wide, m):
    share = m / (m + PRIOR_PAGES)
    return share * own + (1 - share) * wide


def _branch_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hash(path) for path in batch.column(1).to_pylist()], pa.int64())], names=["host", "feature"])


def judged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (host, path, feature, importance, open) and nodes (host, path, importance, highest) of the tree, from (host, html) rows;
    ``highest`` is the most importance of a node's branch, ``open`` whether the text stands anywhere without a prior."""
    small_batches(pages.sparkSession)
    rows = pages.select("host", "html").mapInArrow(_features, "host string, kind int, path string, feature bigint, body bigint, open boolean")
    on = materialize(rows.groupBy("host", "kind", "path", "feature", "body").agg(F.max("open").alias("open")), "features")
    size = on.where(F.col("kind") == PAGE).groupBy("host").agg(F.count("*").alias("m"))
    all_m = on.where(F.col("kind") == PAGE).select("body").distinct().count()
    own = on.where(F.col("kind") != PAGE).groupBy("host", "kind", "path", "feature").agg(F.count("*").alias("n"), F.max("open").alias("open"))
    wide = on.where(F.col("kind") != PAGE).select("kind", "path", "feature", "body").distinct().groupBy("kind", "path", "feature").agg(F.count("*").alias("n"))
    texts = own.where(F.col("kind") == TEXT).drop("kind").join(size, "host").join(wide.where(F.col("kind") == TEXT).select("feature", F.col("n").alias("all_n")), "feature")
    said = F.when(F.col("m") > 1, 1 - F.log("n") / F.log("m")).otherwise(1.0)
    text = _blend(said, 1 - F.log("all_n") / math.log(all_m) if all_m > 1 else F.lit(1.0), F.col("m"))
    texts = materialize(texts.select("host", "path", "feature", text.alias("text"), "open"), "texts")

    styles = _presentation(own.where(F.col("kind") == STYLE), "host", "path").join(size, "host")
    everywhere = _presentation(wide.where(F.col("kind") == STYLE), "path").toDF("path", "all_entropy", "all_weight")
    nodes = styles.join(everywhere, "path").select("host", "path", _blend(F.col("entropy"), F.col("all_entropy"), F.col("m")).alias("entropy"), _blend(F.col("weight"), F.col("all_weight"), F.col("m")).alias("weight"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    inner = nodes.select("host", parent.alias("path")).groupBy("host", "path").agg(F.count("*").alias("inner"))
    nodes = nodes.join(texts.groupBy("host", "path").agg(F.avg("text").alias("text")), ["host", "path"], "left").join(inner, ["host", "path"], "left")
    parts = F.coalesce("inner", F.lit(0)) + F.col("text").isNotNull().cast("int")
    down = F.col("weight") / F.greatest(F.lit(1), parts)
    nodes = materialize(nodes.select("host", "path", "entropy", "weight", down.alias("down"), ((1 - F.col("weight")) * F.col("entropy") + F.coalesce(down * F.col("text"), F.lit(0.0))).alias("part")), "nodes")

    # A node's part counts in each ancestor by the product of the factors on the way: a node has at most MAX_DEPTH ancestors.
    cut = F.split(F.expr("substring(path, 2)"), "/")
    way = nodes.select("host", "path", "part", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(cut, 1, i), "/")))).alias("depth", "above"))
    factors = nodes.select("host", F.col("path").alias("above"), "down")
    steps = way.join(factors, ["host", "above"]).groupBy("host", "path").agg(F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("depth", "above", "down"))).alias("steps"))
    shares = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.struct(F.get(F.col("steps"), i - 1)["above"].alias("above"), F.aggregate(F.slice(F.col("steps"), i, F.size("steps") - i), F.col("part"), lambda acc, x: acc * x["down"]).alias("share")))
    branch = steps.select("host", "path", F.explode(shares).alias("s")).select("host", "path", "s.*")
    importance = branch.groupBy("host", F.col("above").alias("path")).agg(F.sum("share").alias("importance"))
    importance = materialize(importance, "importance")
    highest = branch.select("host", "path", "above").join(importance, ["host", "path"]).groupBy("host", F.col("above").alias("path")).agg(F.max("importance").alias("highest"))
    nodes = materialize(nodes.join(importance, ["host", "path"]).join(highest, ["host", "path"]), "tree")
    texts = texts.join(nodes.select("host", "path", "entropy", "weight"), ["host", "path"])
    saved = F.greatest("text", (1 - F.col("weight")) * F.col("entropy") + F.col("weight") * F.col("text"))
    return texts.select("host", "path", "feature", saved.alias("importance"), "open"), nodes.select("host", "path", "importance", "highest")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance, highest) of every node of the tree, see ``judged``."""
    return judged(pages)[1]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(page, frozenset(noisy or ())) for page, noisy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Pages without a url, or whose url has no host, share one nameless host.
    Null and repeated ids are carried through, repeated pages have equal texts and count once in the tree. A page of any length is read
    whole, by one task. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    texts, nodes = judged(rows)
    low = nodes.where(F.col("highest") < MIN_IMPORTANCE).select("host", "path").mapInArrow(_branch_hashes, "host string, feature bigint")
    noisy = texts.where(F.col("open") & (F.col("importance") < MIN_IMPORTANCE)).select("host", "feature").union(low).groupBy("host").agg(F.collect_set("feature").alias("noisy"))
    noisy = materialize(noisy, "noisy")
    if (noisy.agg(F.sum(F.size("noisy"))).first()[0] or 0) <= BROADCAST_TEXTS:
        joined = rows.join(F.broadcast(noisy), "host", "left")
    else:
        salted = noisy.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "noisy").mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
