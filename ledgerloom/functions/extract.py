"""Field extraction from decision texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def docket(c: Column) -> Column:
    """YYYY-CODE-NNNNN; the number is filled to five digits, longer ones stay."""
    pattern = "(?i)\\b(\\d{4})-?(PER|INA|TLN)-?(\\d{3,6})\\b"
    number = _group(c, pattern, 3)
    filled = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return F.concat(_group(c, pattern), F.lit("-"), F.upper(_group(c, pattern, 2)), F.lit("-"), filled)


def decision_date(c: Column) -> Column:
    """ISO first, then the whole value, then a date inside it."""
    def parse(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, "\\.", ""), "(?i)\\bSept\\b", "Sep")
        return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd")))

    # Candidates of each form in their order in the text; one that is no date doesn't end the search.
    said = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in ("\\d{4}-\\d{2}-\\d{2}", "\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}", "[A-Z][a-z]{2,8}\\.? \\d{1,2}, \\d{4}"))))
    inside = F.get(F.filter(F.transform(said, parse), lambda d: d.isNotNull()), F.lit(0))
    return F.to_date(F.coalesce(F.try_to_timestamp(_group(c, "^(\\d{4}-\\d{2}-\\d{2})T"), F.lit("yyyy-MM-dd")), parse(F.trim(c)), inside))


def stable_id(docket_: Column, doc_type: Column, date: Column, url: Column, *content: Column) -> Column:
    blank = F.lit("")
    by_docket = F.concat_ws("::", docket_, F.coalesce(doc_type, blank), F.coalesce(date.cast("string"), blank))
    return F.when(docket_.isNotNull(), by_docket).when(url.isNotNull(), F.concat(F.lit("url::"), url)).otherwise(F.concat(F.lit("content::"), F.substring(F.sha2(F.concat_ws("::", *content), 256), 1, 16)))


# Wording that decides a board outcome, in order of precedence.
_BOARD = (
    ("(?is)(?:VACAT|vacating).{0,200}?REMAND|REMAND.{0,200}?VACAT", "Remanded"),
    ("(?i)certif\\w*\\s+(?:is\\s+)?GRANTED|HEREBY\\s+GRANT|IT\\s+IS\\s+(?:HEREBY\\s+)?ORDERED\\s+that\\s+(?:labor\\s+)?certif\\w+\\s+(?:is\\s+)?GRANT", "Reversed"),
    ("(?i)\\b(?:VACAT\\w+|vacating\\s+the\\s+denial)\\b", "Reversed"),
    ("(?i)\\bREMAND\\w*\\b", "Remanded"),
    ("(?i)\\bREVERS\\w*\\b", "Reversed"),
    ("(?i)\\bAFFIRM\\w*\\b", "Affirmed"),
    ("(?i)\\b(?:DISMISS\\w*|HEREBY\\s*DISMISS\\w*|ADMINISTRATIVELY\\s+CLOS\\w*|WITHDRAWN)\\b", "Dismissed"),
)
# The same for appeals.
_APPEALS = ("Sustained", "Dismissed", "Remanded", "Withdrawn")


def _outcome(text: Column) -> Column:
    out = F.when(text.rlike(_BOARD[0][0]), _BOARD[0][1])
    for pattern, label in _BOARD[1:]:
        out = out.when(text.rlike(pattern), label)
    return out


def board_outcome(c: Column) -> Column:
    """By the last 2500 characters, then by the whole text; a blank text has none."""
    tail = F.when(F.length(c) > 2500, F.substring(c, -2500, 2500)).otherwise(c)
    return F.when(F.trim(c) != "", F.coalesce(_outcome(tail), _outcome(c), F.lit("Unknown")))


def appeals_outcome(c: Column) -> Column:
    """The first of the outcomes, in their order, that the last 2000 characters have as a word."""
    tail = F.when(F.length(c) > 2000, F.substring(c, -2000, 2000)).otherwise(c)
    return F.coalesce(*(F.when(tail.rlike(f"(?i)\\b{label}\\b"), label) for label in _APPEALS))


def text_quality(chars: Column, pages: Column) -> Column:
    return F.when(chars == 0, "empty").when(chars / F.greatest(pages, F.lit(1)) < 250, "low_text").when(chars < 1000, "short").otherwise("ok")


def wage_check(required: Column, offered: Column) -> Column:
    """Pass if what is offered lies strictly above what is required; null without either."""
    return F.when(required.isNotNull() & offered.isNotNull(), F.when(offered > required, "Pass").otherwise("Fail"))


def priority_cell(c: Column) -> tuple[Column, Column, Column]:
    """(date, is_current, is_unavailable) of a bulletin cell; two-digit years below 50 are of this century."""
    text = F.upper(F.trim(c))
    year = F.regexp_extract(text, "^\\d{2}[A-Z]{3}(\\d{4}|\\d{2})$", 1)
    full = F.when(F.length(year) == 4, year).when(F.length(year) == 2, F.concat(F.when(year < "50", "20").otherwise("19"), year))
    month = F.initcap(F.substring(text, 3, 3))
    date = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.substring(text, 1, 2), month, full), F.lit("dd MMM yyyy")))
    return F.when(full.isNotNull(), date), text.isin("C", "CURRENT"), text.isin("U", "UNAVAILABLE", "UNAV.")


def form_number(name: Column) -> Column:
    """I-140 of i-140.pdf, N-400 of uscis_N_400_2024.pdf; other letters are no form; null without one."""
    pattern = "(?i)(?:^|[^A-Za-z])(I|N)[-_](\\d+[A-Z]?)(?![A-Za-z0-9])"
    return F.upper(F.concat(_group(name, pattern), F.lit("-"), _group(name, pattern, 2)))


def fiscal_year(path: Column) -> Column:
    """FY2024 of the folder that a file stands in; the folder's name where it begins otherwise; null without a folder."""
    folder = _group(path, "([^/]+)/[^/]*$")
    return F.coalesce(_group(folder, "^(FY\\d{4})"), folder)


def safe_name(label: Column) -> Column:
    """A label as a file name: runs of other characters than letters, digits, points and hyphens become one underscore."""
    return F.nullif(F.btrim(F.regexp_replace(label, "[^A-Za-z0-9.-]+", "_"), F.lit("_")), F.lit(""))
