"""Fields of experience letters as column expressions, and months of experience over several letters.

A span of employment is looked for where a letter speaks of it: the first trigger phrase that is followed by a date within its line
gives the span; only without one the letter's first two dates do.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bind import let

# How the letters are read.
DATE = (
    r"(?i)(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)[.,]?\s+(?:\d{1,2},?\s+)?\d{4}"
    r"|\d{1,2}[/-]\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}[/-]\d{1,2})"
)
TRIGGER = r"(?i)(?:employed|worked|position|service|from|between|since|period)[^\n.]{0,120}"
PRESENT = r"(?i)\b(?:present|current|ongoing|to\s+date|till\s+date|to\s+present)\b"
NO_LETTERHEAD = r"(?i)^(?:Dear|To Whom|Sincerely|Regards|Best|Thank|Re:|Subject|Date|Reference|This is to|Please|If you|Should you|The above|I am|He|She|They|Mr\.|Ms\.|Mrs\.|Dr\.)"
NAME = r"\b[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\b"
EMPLOYMENT = r"(?i)(?:employed|worked|hired|retained|served)[^\n.]{0,80}"
ROLE = r"(?i)\b(?:Director|Manager|President|VP|Vice|Officer|Head|Supervisor|Partner|Principal|HR|Human Resources|CEO|CFO|CTO)\b"
TITLE = r"(?i)(?:position of|title of|as (?:a|an)|capacity as|role of|served as|employed as|worked as)[,:]?\s+([A-Za-z /\-]{3,60})"
DUTIES = r"(?i)(?:duties|responsibilities|job duties|role included|role includes|tasks|functions|accountabilities)[^\n]{0,40}\n"
CLOSING = r"(?i)(?:sincerely|regards|best wishes|please feel free|if you have any questions|should you have)"
_SKILLS = (
    r"Python|Java(?:Script)?|TypeScript|C\+\+|C#|Ruby|PHP|Swift|Kotlin|Go|Rust|Scala|HTML5?|CSS3?|SQL|NoSQL|React|Angular|Vue|Node(?:\.js)?|Django|Flask|FastAPI|Spring|\.NET|AWS|Azure|GCP|Docker"
    r"|Kubernetes|Terraform|CI/CD|DevOps|Machine Learning|Deep Learning|NLP|TensorFlow|PyTorch|Hadoop|Spark|PostgreSQL|MySQL|MongoDB|Redis|Elasticsearch|Kafka|RabbitMQ|REST(?:ful)?|GraphQL|gRPC|Microservices"
    r"|Agile|Scrum|JIRA|GitHub|GitLab|Git"
).split("|")
# By first letter, each letter's skills in their order: at most words one letter is compared, not all skills.
SKILLS = r"(?i)\b(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(s.removeprefix(chr(92))[1:] for s in _SKILLS if s.removeprefix(chr(92))[0].lower() == c)})" for c in dict.fromkeys(s.removeprefix(chr(92))[0].lower() for s in _SKILLS)) + r")\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def month_of(said: Column) -> Column:
    """The first day of the month that a date names; null where there is no such month."""
    return let(said, _month_of)


def _month_of(said: Column) -> Column:
    named = reduce(lambda out, m: out.when(F.lower(F.substring(said, 1, 3)) == m[1], m[0] + 1), enumerate(MONTHS[1:], 1), F.when(F.lower(F.substring(said, 1, 3)) == MONTHS[0], 1))
    month = F.coalesce(named.cast("string"), _part(said, r"^(\d{1,2})[/-](?:\d{1,2}[/-])?\d{4}$", 1), _part(said, r"^\d{4}[/-](\d{1,2})$", 1))
    year = F.coalesce(_part(said, r"(\d{4})$", 1), _part(said, r"^(\d{4})[/-]", 1))
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lit("01")), F.lit("yyyy-MM-dd")).cast("date")


def employment(text: Column, today: Column) -> Column:
    """struct<start_said, end_said, start, end, months>: the span that the letter states; ``end_said`` is Present where it goes on ``today``."""
    sentence = F.get(F.filter(_all(text, TRIGGER), lambda s: s.rlike(DATE)), F.lit(0))

    def said(source: Column) -> Column:
        return let(_all(source, DATE), lambda dates: F.struct(F.get(dates, F.lit(0)).alias("first"), F.get(dates, F.lit(1)).alias("second"), (F.get(dates, F.lit(1)).isNull() & source.rlike(PRESENT)).alias("goes_on")))

    def months(d: Column) -> Column:
        start, end = d["start"], d["end"]
        n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        return F.struct(d["first"].alias("start_said"), F.coalesce(d["second"], F.when(d["goes_on"], "Present")).alias("end_said"), start.alias("start"), end.alias("end"), F.when(end >= start, n).alias("months"))

    def span(s: Column) -> Column:
        ends = F.coalesce(month_of(s["second"]), F.when(s["goes_on"], today))
        return let(F.struct(s["first"].alias("first"), s["second"].alias("second"), s["goes_on"].alias("goes_on"), month_of(s["first"]).alias("start"), ends.alias("end")), months)

    return let(let(F.coalesce(sentence, text), said), span)


def fields(text: Column, today: Column) -> Column:
    """struct<employer, signer_title, beneficiary, job_title, span, duties, skills> of a letter; null where it says nothing of a field."""
    return let(F.filter(F.transform(F.split(text, "\n"), _strip), lambda s: s != ""), lambda lines: _fields(text, lines, today))


def _fields(text: Column, lines: Column, today: Column) -> Column:
    employer = F.get(F.filter(F.slice(lines, 1, 6), lambda s: ~s.rlike(NO_LETTERHEAD) & (F.length(s) > 3)), F.lit(0))
    beneficiary = _part(_part(text, EMPLOYMENT, 0), NAME, 0)
    last = F.when(F.size(lines) > 20, F.slice(lines, -20, 20)).otherwise(lines)
    after = let(last, lambda tail: F.transform(tail, lambda s, i: F.struct(s.alias("name"), F.get(tail, i + 1).alias("title"))))
    signed = F.filter(after, lambda p: p["name"].rlike("^" + NAME) & (F.length(p["title"]) < 80) & p["title"].rlike(ROLE))
    said = _strip(F.get(F.split(_strip(_part(text, TITLE, 1)), r"[,\n]"), F.lit(0)))
    job_title = let(said, lambda s: F.when(F.length(s).between(3, 60), s))
    stated = _strip(F.get(F.split(_part(text, f"(?s){DUTIES}(.*)", 1), CLOSING, 2), F.lit(0)))
    long_ones = F.filter(F.transform(F.split(text, r"\n{2,}"), _strip), lambda p: (F.length(p) > 150) & ~p.rlike(CLOSING))
    longest = F.aggregate(long_ones, F.lit(None).cast("string"), lambda best, p: F.when(best.isNull() | (F.length(p) > F.length(best)), p).otherwise(best))
    duties = F.when(text.rlike(DUTIES), F.coalesce(stated, F.lit(""))).otherwise(longest)

    def skills(duties: Column) -> Column:
        found = F.array_distinct(_all(F.coalesce(F.nullif(duties, F.lit("")), text), SKILLS))
        return F.transform(F.array_sort(F.transform(found, lambda s: F.struct(F.lower(s).alias("key"), s.alias("skill")))), lambda p: p["skill"])

    return let(duties, lambda duties: F.struct(
        employer.alias("employer"), F.get(signed, F.lit(0))["title"].alias("signer_title"), beneficiary.alias("beneficiary"), job_title.alias("job_title"), employment(text, today).alias("span"), duties.alias("duties"), skills(duties).alias("skills"),
    ))


def months_of_experience(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, jobs, months, first, last) of spans of employment: time in several jobs at once counts once.

    Spans are islands of a running latest end; a span without a start or an end, or that ends before it starts, is left out.
    Equal spans are of one island, by the frame's range, in whatever order the windows meet them.
    """
    rows = spans.where(F.col(end) >= F.col(start)).select(key, F.col(start).alias("s"), F.col(end).alias("e"))
    before = F.max("e").over(Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("begins", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    islands = begins.withColumn("island", F.sum("begins").over(Window.partitionBy(key).orderBy("s", "e").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("jobs"))
    months = (F.year("e") - F.year("s")) * 12 + F.month("e") - F.month("s")
    return merged.groupBy(key).agg(F.sum("jobs").alias("jobs"), F.sum(months).cast("bigint").alias("months"), F.min("s").alias("first"), F.max("e").alias("last"))
