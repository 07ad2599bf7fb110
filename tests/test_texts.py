"""Diffs, chunks, heading paths, forms, letters and manuals, by literals and brute force."""

import datetime
import random
import re
from html import unescape

from pyspark.sql import functions as F

from ledgerloom.functions import chunk, diff, letters, manuals, wage_form
from ledgerloom.functions.extract import board_outcome, decision_date
from ledgerloom.plans import registry

from .oracle import DATA


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table


def test_script_is_the_quadratic_one():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(20))] for _ in range(2))
        table, steps, i, j = common(a, b), diff.script(a, b), 0, 0
        assert steps.count("=") == table[0][0]
        for step in steps:  # pairs at once, else removes where that loses nothing
            want = "+" if i == len(a) else "-" if j == len(b) else "=" if a[i] == b[j] else "-" if table[i + 1][j] >= table[i][j + 1] else "+"
            assert step == want
            i, j = i + (step != "+"), j + (step != "-")
        assert (i, j) == (len(a), len(b))


def test_compare_modes(spark):
    part = lambda *p: [{"text": t, "changed": c} for t, c in p]
    assert diff.compare("a b\nsame", "a c\r\nsame\nnew") == [
        (1, 1, True, part(("a ", False), ("b", True)), part(("a ", False), ("c", True))), (2, 2, False, part(("same", False)), part(("same", False))), (None, 3, True, [], part(("new", True)))]
    assert diff.compare("abc", "abd", strict=True) == [(1, 1, True, part(("ab", False), ("c", True)), part(("ab", False), ("d", True)))]
    assert [d[2] for d in diff.compare("- A b\n\n2) c", "a B\nC", ignore_format=True)] == [False]
    rows = spark.createDataFrame([(1, "x\ny", "x\nz"), (2, None, ""), (3, "* q", "Q")], "id bigint, reference string, compared string")
    assert [tuple(r) for r in diff.summary(rows, "id").orderBy("id").collect()] == [(1, False, "Differences Found", "1 differing line.", 1), (2, True, "Exact Match", "Texts are identical.", 0), (3, False, "Differences Found", "1 differing line.", 1)]
    assert diff.summary(rows.where("id = 3"), "id", ignore_format=True).first().exact
    out = diff.line_diff(rows, "id").collect()
    assert "".join(p.text for r in out if r.id == 1 for p in r.ref_parts) == "xy"
    long = [f"line {i}" for i in range(3000)]
    assert diff.script(long, long[:1500] + ["x"] + long[1500:]).count("=") == 3000


def by_hand(text, target, overlap):
    """The chunk rule, told as one loop over paragraphs."""
    out, held, tail = [], [], ""

    def end(body):
        nonlocal tail
        out.append((tail + body).strip())
        keep = body[-overlap * 4 :]
        tail = (body if len(body) <= overlap * 4 else keep[keep.find(" ") + 1 :] if keep.find(" ") > 0 else keep) + " "

    for p in (x.strip() for x in re.sub("\n{3,}", "\n\n", (text or "").replace("\r\n", "\n")).split("\n\n")):
        if p and max(1, len(p) // 4) > target:
            if held:
                end(" ".join(held))
            held, run = [], []
            for s in re.split(r"(?<=[.!?])\s+", p):
                if run and sum(max(1, len(x) // 4) for x in run) + max(1, len(s) // 4) > target:
                    end(" ".join(run))
                    run = []
                run.append(s)
            end(" ".join(run))
        elif p:
            if held and sum(max(1, len(x) // 4) for x in held) + max(1, len(p) // 4) > target:
                end(" ".join(held))
                held = []
            held.append(p)
    if held:
        end(" ".join(held))
    return out


def test_chunks_follow_the_rule(spark):
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "another. ", "x! ", "\n\n", "\r\n\r\n", "\n", "longerword", "\n\n\n\n", "Sentence here? "]) for _ in range(rng.randrange(0, 150)))
        target, overlap = rng.choice([5, 12, 40]), rng.choice([2, 4])
        assert chunk.chunk(text, target, overlap) == by_hand(text, target, overlap)
    assert chunk.chunk(None) == chunk.chunk(" \n\n ") == []
    assert chunk.chunk_sections("intro\n§ 204.5 Petitions\nbody\n§ 204.6a x", 600) == ["intro", "§ 204.5\n Petitions\nbody", "§ 204.6a\n x"]
    rows = registry.queries()["chunk_paragraphs"](spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    want = {i: by_hand(t.replace("\n", "\n\n"), 200, 20) for i, t in docs.items() if t and t.strip()}
    assert got == {i: c for i, c in want.items() if c}


def test_corpora_and_headings(spark):
    rows = [(1, "One two.", datetime.date(2020, 1, 1), True, None), (2, "", datetime.date(2020, 1, 2), True, "b"), (3, "Three", None, True, "c"), (4, "Four", datetime.date(2021, 1, 1), False, "d"), (5, None, None, True, "e")]
    docs = spark.createDataFrame(rows, "id int, t string, d date, ok boolean, label string")
    made = chunk.chunk_corpus(docs, "board", "id", "t", label=F.col("label"), date=F.col("d"), carried={"outcome": F.lit("x")}, eligible=F.col("ok")).orderBy("source_id").collect()
    assert [(r.source_id, r.source_label, r.chunk_text, r.chunk_tokens, r.outcome) for r in made] == [("1", "board-1", "One two.", 2, "x"), ("3", "c", "Three", 1, "x")]
    assert [r.source_id for r in chunk.chunk_corpus(docs, "b", "id", "t", date=F.col("d"), since="2020-06-01").collect()] == ["4"]
    label, text = chunk.headed(F.col("n"), F.col("h"), F.col("t"))
    got = spark.createDataFrame([("1101", "Definitions", "text"), ("1", None, "x"), ("2", "t", " ")], "n string, h string, t string").select(label, text).collect()
    assert [tuple(r) for r in got] == [("§ 1101 — Definitions", "§ 1101 — Definitions\n\ntext"), ("§ 1", "§ 1\n\nx"), ("§ 2 — t", None)]
    lines = [("f", 1, None, "a"), ("f", 2, 1, "I"), ("f", 3, 3, "deep"), ("f", 4, None, "b"), ("f", 5, 2, "II"), ("f", 6, None, "c"), ("f", 7, 1, "III"), ("f", 8, None, "d")]
    paths = chunk.heading_paths(spark.createDataFrame(lines, "file string, place bigint, level int, title string"), "file", "place", "level", "title").orderBy("place").collect()
    assert [r.path for r in paths] == [[], ["I"], ["I", "deep"], ["I", "deep"], ["I", "II"], ["I", "II"], ["III"], ["III"]]


def test_letters(spark):
    first = "Acme Corp\n\nDear Sir,\nWe employed Ann Bell as a Chef, from Jan. 2015 to 03/2018.\nDuties:\n\tUsed Python, C++ and java.\nSincerely,\nBob Stone\nDirector of Food\n"
    rows = [(1, first), (2, "Beta LLC\nworked since 2017-02 to present as an Analyst.\n"), (3, ""), (4, None), (5, "Gamma Inc\nNo trigger. 02/2019 and 13/2019."), (6, "X Ltd\nperiod of 05/01/2020 - 04/01/2019.")]
    today = F.lit(datetime.date(2020, 5, 20))
    got = {r.id: r.f for r in spark.createDataFrame(rows, "id int, t string").select("id", letters.fields(F.col("t"), today).alias("f")).collect()}
    a = got[1]
    assert (a.employer, a.beneficiary, a.job_title, a.signer_title, a.duties, a.skills) == ("Acme Corp", "Ann Bell", "Chef", "Director of Food", "Used Python, C++ and java.", ["java", "Python"])
    assert (a.span.start_said, a.span.start, a.span.end, a.span.months) == ("Jan. 2015", datetime.date(2015, 1, 1), datetime.date(2018, 3, 1), 38)
    assert (got[2].span.end_said, got[2].span.end, got[2].span.months, got[2].job_title) == ("Present", datetime.date(2020, 5, 20), 39, "Analyst")
    assert got[3].employer is None and got[4].span.start is None and got[4].skills is None
    assert (got[5].span.start, got[5].span.end, got[5].span.months) == (datetime.date(2019, 2, 1), None, None) and got[6].span.months is None


def test_overlapping_jobs_count_once(spark):
    d = datetime.date
    spans = [("a", d(2015, 1, 1), d(2018, 3, 1)), ("a", d(2017, 1, 1), d(2019, 1, 1)), ("a", d(2016, 1, 1), d(2016, 2, 1)), ("a", d(2019, 6, 1), d(2019, 8, 1)), ("b", None, d(2019, 8, 1)), ("c", d(2019, 1, 1), d(2018, 1, 1)), ("d", d(2019, 1, 1), d(2019, 1, 1))]
    got = letters.months_of_experience(spark.createDataFrame(spans, "who string, start date, end date"), "who").orderBy("who").collect()
    assert [tuple(r) for r in got] == [("a", 4, 50, d(2015, 1, 1), d(2019, 8, 1)), ("d", 1, 0, d(2019, 1, 1), d(2019, 1, 1))]


def test_wage_forms(spark):
    new = ["cover", "1. Job title *\nData Scientist II\n2. Job duties *\nPlease see addendum\nForm ETA-9141", "1. Education: ☐ None ☒ Master's ☐ Doctorate\n2. Does the employer require a second\n5. Special skills or other requirements\nSQL needed\nc. Alternative",
           "3. Will travel be required? ☑ Yes ☐ No\n3. City *  4. State *  5. County *\nSalt Lake City  UT  Salt Lake", "G. Prevailing Wage\n4. Prevailing wage\n $ 153,601 . 00\na. Per:\n☐ Hour ☒ Month", "Addendum for Section F.a.2: Job Duties\nDoes  data\nscience.\nPage 6 of 7"]
    old = ["c", "1. Job Title *  Chef\n5. Job duties: begin in this space. *\nCooks.\n6. Will travel be required? Yes ✘ No\n1. Education\n✘ Bachelor's\n2. Does the employer\n5. Special Requirements - job opportunity. *\nKnives\nc. Place of Employment", "3. City *   Boise  \n4. State *  ID \n",
           "4. Prevailing wage $ 45,000.50\n5. Per:\n✘ Hour", "", "ADDENDUM FOR SECTION E.B.5\nMore knives\nPage 6"]
    rows = spark.createDataFrame([(1, new), (2, old), (3, []), (4, None), (5, [None, "x"])], "id int, p array<string>")
    got = [tuple(r) for r in rows.select("id", wage_form.fields(F.col("p")).alias("f")).orderBy("id").select("f.*").collect()]
    assert got[0] == ("new", "Data Scientist II", "Salt Lake City", "UT", "yes", "Does data science.", "Master's", "5. Special skills or other requirements SQL needed", "$153,601 / Month")
    assert got[1] == ("old", "Chef", "Boise", "ID", "no", "Cooks.", "Bachelor's", "Knives\n\nMore knives", "$45,000 / Hour")
    assert all(r == ("old", None, None, None, "no", None, None, None, None) for r in got[2:])
    pages = spark.createDataFrame([(["a" * 3000, None, "  ", "b"],), ([" "],)], "p array<string>")
    assert [r[0] for r in pages.select(wage_form.whole_text(F.col("p"))).collect()] == ["a" * 3000 + "\n\nb", None]
    assert pages.select(wage_form.page_texts(F.col("p")).alias("m")).first().m == {"page_1": "a" * 2000, "page_2": "", "page_3": "  ", "page_4": "b"}


def split_by_hand(pages):
    out, held, volume, section, subject = [], [], None, "Introduction", "Policy Manual Introduction"
    for i, text in enumerate(pages):
        m = re.search(r"(?i)(Volume\s+[IVX\d]+[,\s–—-]+(?:Part\s+[A-Z])?)", text[:300])
        if m and i > 5:
            label = m[1].strip()
            if volume and label != volume and len(held) > 3:
                out.append((section, subject, "\n\n".join(held)))
                held = []
            volume = section = label
            said = re.search(r"Part\s+[A-Z]\s*[–—-]\s*(.+?)(?:\n|$)", text[:400])
            subject = said[1].strip()[:120] if said else label
        held.append(text)
    return [*out, (section, subject, "\n\n".join(held))] if held else out


def test_manuals(spark):
    rng = random.Random(5)
    files = {f"m{f}": [rng.choice(["", "", "", "Volume 1, Part A – Alpha\n", "Volume 2\n", "volume IV - Part B - Beta\nmore "]) + f"p{i}" for i in range(rng.choice([0, 3, 7, 30, 60]))] for f in range(12)}
    rows = [(f, i, t) for f, pages in files.items() for i, t in enumerate(pages)]
    rng.shuffle(rows)
    got = {}
    parts = manuals.split_manual(spark.createDataFrame(rows, "file string, page int, text string")).orderBy("file", "nth").collect()
    for r in parts:
        got.setdefault(r.file, []).append((r.section, r.subject, r.full_text))
    assert got == {f: split_by_hand(p) for f, p in files.items() if p}
    assert all(len({r.filename for r in parts if r.file == f}) == len(got[f]) for f in got)
    names = spark.createDataFrame([("8 FAM 303.1 non-immigrant visas.pdf",), ("other.pdf",)], "n string").select(manuals.policy_name(F.col("n")).alias("p")).collect()
    assert [tuple(r.p) for r in names] == [("8 FAM 303.1", "Non-Immigrant Visas", "8 FAM 303.1 — Non-Immigrant Visas"), (None, None, "other")]
    dates = spark.createDataFrame([("of 1/31/24 x",), ("2/30/2024",), ("12/1/1970",), ("none",), (None,)], "t string").select(manuals.as_of(F.col("t"))).collect()
    assert [r[0] for r in dates] == [datetime.date(2024, 1, 31), None, datetime.date(1970, 12, 1), None, None]


def test_dates_and_outcomes(spark):
    dates = spark.createDataFrame([("filed 99/99/2020, decided January 4, 2025",), ("99/99/2020 then 1/5/2021",), ("2020-13-01 or 2020-12-01",), ("none",), (None,)], "t string").select(decision_date(F.col("t"))).collect()
    assert [r[0] for r in dates] == [datetime.date(2025, 1, 4), datetime.date(2021, 1, 5), datetime.date(2020, 12, 1), None, None]
    said = ["HEREBYDISMISSED", "is HEREBY DISMISSED", "vacating the denial", "nothing", " "]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(board_outcome(F.col("t"))).collect()] == ["Dismissed", "Dismissed", "Reversed", "Unknown", None]


def test_links_and_articles_of_pages_by_hand(spark):
    """Every page's links and article against regular expressions over its own mark-up."""
    found, texts = {}, {r.page_id: r.text for r in registry.queries()["html_text"](spark, DATA).collect()}
    for r in registry.queries()["html_links"](spark, DATA).collect():
        found.setdefault(r.page_id, []).append((r.position, r.href, r.label))
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(texts) == len(rows)
    for r in rows:
        html = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", r.html or "")
        want = [(unescape(h), " ".join(unescape(re.sub(r"<[^>]*>", "", t)).split())) for h, t in re.findall(r"(?s)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", html)]
        assert [(h, t) for _, h, t in sorted(found.get(r.page_id, []))] == want
        chrome = re.sub(r"(?s)<(nav|footer|header)\b.*?</\1>", "", html)
        for said in re.findall(r"(?s)<h[234][^>]*>([^<]{4,})</h[234]>", chrome):
            assert " ".join(unescape(said).split()) in texts[r.page_id]
        assert all(a != b for a, b in zip(texts[r.page_id].split("\n"), texts[r.page_id].split("\n")[1:]))


def test_citations_of_every_text_by_hand(spark):
    got = {}
    for r in registry.queries()["citation_extract"](spark, DATA).collect():
        got.setdefault(r.citing_id, []).append((r.citation_type, r.cited_raw))
    for i in (r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()):
        want = [("precedent", f"25 I&N Dec. {i % 500}")] + ([("board", f"2006-PER-{i}")] if i < 100_000 else [])
        assert got[i] == want
