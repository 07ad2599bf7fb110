"""Nine fields of a wage determination form from the texts of its pages, for both layouts, as column expressions.

A field is read from its numbered label within the pages that a layout gives its section: the first of the label's forms that
reads something counts. Long answers that are moved to an addendum are looked up there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

# How a checked box is rendered, and what can be checked, in order of precedence.
CHECK = "[✘✗☒☑✔✓x]"
DEGREES = (
    (r"\bNone\b", "None"), (r"High [Ss]chool|GED", "High School/GED"), ("Associate", "Associate's"), ("Bachelor", "Bachelor's"), ("Master", "Master's"),
    (r"Doctorate|Ph\.?D", "Doctorate (Ph.D.)"), ("Other degree", "Other"),
)
UNITS = ("Hour", "Week", "Bi-Weekly", "Month", "Year", "Piece Rate")
NEW_LAYOUT = r"(?i)\bG\.\s*Prevailing Wage"
ADDENDUM = r"(?is)Addendum for Section[^\n]*\n(.*?)(?=Page \d+|\z)"
ADDENDUM_HEADED = r"(?is)ADDENDUM\s*\n[^\n]*\n(.*?)(?=Page \d+|\z)"
ELSEWHERE = r"(?i)please see addendum"


@dataclass(frozen=True)
class Layout:
    """Where a layout's fields stand. Patterns read their first group; pages are (first index, number)."""

    body: tuple[int, int]
    duties: str
    duties_addendum: str
    skills: str
    skills_addendum: str
    education: str
    travel: str
    state_label: str
    unit: str
    wages: tuple[str, ...]


# The labels of the layouts of 2025 and 2021.
NEW = Layout(
    (1, 6), r"(?is)2\.\s*Job duties[^\n]*\n(.*?)(?=\nForm ETA|\z)", r"(?:F\.a\.2|Section F\.a\.2|Job Duties)", r"(?is)(5\.\s*Special skills or other requirements.*?)(?=\nc\.\s*Alternative|\z)",
    r"(?:F\.b\.5|Section F\.b\.5|Special Skills)", r"(?is)(1\.\s*Education:.*?)(?=2\.\s*Does the employer require a second|\z)", r"(?is)(3\.\s*Will travel be required.{0,500})", r"4\.", r"(?i)(a\.\s*Per:(?:\n[^\n]*){0,3})",
    (r"(?i)4\.\s*Prevailing wage[^\n]*\n[^\n]*\$\s*([\d,]{4,})", r"\$\s*([\d,]{5,})\s*\.\s*00", r"\$\s*([\d,]{5,})"),
)
OLD = Layout(
    (1, 5), r"(?is)5\.\s*Job duties[^\n]*\n(.*?)(?=\n6\.\s*Will travel|\z)", r"(?:E\.a\.5|E\.5|Job Duties)", r"(?is)5\.\s*Special Requirements[^\n]*\n(.*?)(?=\nc\.\s*Place of Employment|\z)",
    r"(?:E\.b\.5|E\.B\.5|SPECIAL REQUIREMENTS)", r"(?is)(1\.\s*Education.*?)(?=2\.\s*Does the employer|\z)", r"(?is)(6\.\s*Will travel be required.{0,400})", r"(?:4\.|5\.)", r"(?i)(5\.\s*Per:(?:\n[^\n]*){0,3})",
    (r"(?i)4\.\s*Prevailing wage[\s\S]{0,40}?\$\s*([\d,]{4,}(?:\.\d+)?)",),
)


def _clean(c: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def _read(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def _joined(pages: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(pages, first + 1, n), "\n")


def addendum(pages: Column, section: str) -> Column:
    """The text of the first page from the fifth on that is headed as the addendum of a section and says something."""
    headed = rf"(?i)(?:Addendum for Section {section}|ADDENDUM[\s\S]{{0,100}}{section})"
    later = F.filter(F.slice(pages, 5, 1_000_000), lambda p: p.rlike(headed))
    said = F.transform(later, lambda p: F.coalesce(_clean(_read(p, ADDENDUM)), _clean(_read(p, ADDENDUM_HEADED))))
    return F.get(F.filter(said, lambda s: s.isNotNull()), F.lit(0))


def _degree(block: Column) -> Column:
    return let(block, _checked_degree)


def _checked_degree(block: Column) -> Column:
    out = reduce(lambda out, d: out.when(block.rlike(rf"(?i){CHECK}\s*(?:{d[0]})\b"), d[1]), DEGREES[1:], F.when(block.rlike(rf"(?i){CHECK}\s*(?:{DEGREES[0][0]})\b"), DEGREES[0][1]))
    return F.coalesce(out, F.when(block.rlike(r"\bNone\b"), "None"))


def _unit(block: Column) -> Column:
    return let(block, _checked_unit)


def _checked_unit(block: Column) -> Column:
    out = reduce(lambda out, u: out.when(block.rlike(rf"(?i){CHECK}\s*{u}"), u), UNITS[1:], F.when(block.rlike(rf"(?i){CHECK}\s*{UNITS[0]}"), UNITS[0]))
    return F.coalesce(out, F.lit("Year"))


def _place(body: Column, state: str) -> tuple[Column, Column]:
    """City and state: both on the line below their labels, each below its own, or beside it."""
    below = F.split(F.btrim(_read(body, rf"(?i)3\.\s*City[^\n]*{state}\s*State[^\n]*\n(\S[^\n]+)")), " {2,}")
    own = F.regexp_replace(_read(body, r"(?i)3\.\s*City\s*\*?\s*\n([^\n]{1,60})"), r"[45]\..*", "")
    city = F.coalesce(_clean(F.get(below, F.lit(0))), _clean(own), _clean(_read(body, r"(?i)3\.\s*City\s*\*?\s+([A-Za-z][^\n\t]{1,40}?)\s{2,}")))
    code = F.coalesce(_clean(F.get(below, F.lit(1))), _read(body, rf"(?i){state}?\s*State[^\n]*\n([A-Z]{{2}})\b"), _read(body, rf"(?i){state}\s*State\s*[^\n]{{0,10}}?\s+([A-Z]{{2}})\b"))
    return city, code


def _old_answer(c: Column, opening: str) -> Column:
    return _clean(F.regexp_replace(F.regexp_replace(c, rf"(?is)^.*?{opening}\.?\s*\*?\s*\n?", ""), r"(?s)Page \d+ of \d+.*$", ""))


def fields(pages: Column) -> Column:
    """struct<layout, job_title, city, state, travel, duties, degree, skills, wage> of array<string> pages; null where nothing is read.

    Null pages are empty ones. ``travel`` is yes only where Yes is checked and No isn't; ``wage`` has its unit, a year where none is checked in the
    three lines below its label.
    """
    return let(F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(""))), _fields)


def _fields(pages: Column) -> Column:
    new = _joined(pages, 0, 6).rlike(NEW_LAYOUT)

    def read(form: Layout) -> Column:
        return let(_joined(pages, *form.body), lambda body: fields_of(form, body))

    def fields_of(form: Layout, body: Column) -> Column:
        title = _clean(_read(body, r"(?i)1\.\s*Job title\s*\*?\s*(?:\n|[ \t]{2,})([^\n*]{2,80})"))
        duties, skills = _read(body, form.duties), _read(body, form.skills)
        more_duties, more_skills = addendum(pages, form.duties_addendum), addendum(pages, form.skills_addendum)
        if form is NEW:
            duties, skills = (F.coalesce(more, let(_clean(own), lambda own: F.when(~own.rlike(ELSEWHERE), own))) for own, more in ((duties, more_duties), (skills, more_skills)))
            wages = F.when(F.size(pages) > 4, _joined(pages, 4, 3)).otherwise(F.array_join(pages, "\n"))
        else:
            duties = let(_old_answer(duties, "begin in this space"), lambda own: F.when(own.isNull() | own.rlike(ELSEWHERE), F.coalesce(more_duties, own)).otherwise(own))
            both = F.struct(_old_answer(skills, "job opportunity").alias("own"), more_skills.alias("more"))
            skills = let(both, lambda s: F.when(s["more"].isNull() | F.contains(F.coalesce(s["own"], F.lit("")), s["more"]), s["own"]).otherwise(F.concat_ws("\n\n", s["own"], s["more"])))
            wages = F.coalesce(F.get(pages, F.lit(3)), F.lit(""))
        goes = F.coalesce(let(_read(body, form.travel), lambda block: block.rlike(rf"(?i){CHECK}\s*Yes") & ~block.rlike(rf"(?i){CHECK}\s*No")), F.lit(False))
        city, state = _place(body, form.state_label)
        amount = lambda wages: let(F.replace(_read(wages, *form.wages), F.lit(","), F.lit("")), lambda a: F.coalesce(F.format_number(a.try_cast("double"), 0), a))
        wage = let(wages, lambda wages: F.concat(F.lit("$"), amount(wages), F.lit(" / "), _unit(F.coalesce(_read(wages, form.unit), F.lit("")))))
        return F.struct(
            F.lit("new" if form is NEW else "old").alias("layout"), title.alias("job_title"), city.alias("city"), state.alias("state"), F.when(goes, "yes").otherwise("no").alias("travel"), duties.alias("duties"),
            _degree(F.coalesce(_read(body, form.education), body)).alias("degree"), skills.alias("skills"), wage.alias("wage"),
        )

    return F.when(new, read(NEW)).otherwise(read(OLD))


def page_texts(pages: Column, most_pages: int = 8, most_chars: int = 2000) -> Column:
    """map from page_1 on to the beginning of each of the first pages, as a look at what a file holds."""
    few = F.slice(pages, 1, most_pages)
    return F.map_from_entries(F.transform(few, lambda p, i: F.struct(F.concat(F.lit("page_"), (i + 1).cast("string")), F.substring(F.coalesce(p, F.lit("")), 1, most_chars))))


def whole_text(pages: Column) -> Column:
    """Pages that aren't blank, a blank line between them; null if nothing was extracted."""
    said = F.filter(pages, lambda p: F.coalesce(F.btrim(p), F.lit("")) != "")
    return F.nullif(F.array_join(said, "\n\n"), F.lit(""))
