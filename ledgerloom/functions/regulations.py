"""Fields of regulation files, adopted decisions and precedent entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import collapse

# Who issues a title, and what its parts are called.
AGENCIES = ((8, "DHS / USCIS"), (20, "DOL / ETA"), (22, "State Department"), (29, "DOL / WHD"))
PARTS = {
    "103": "Fees, Waivers, and Guarantors",
    "204": "Immigrant Petitions",
    "205": "Revocation of Approval",
    "207": "Admission of Refugees",
    "208": "Asylum and Withholding",
    "209": "Adjustment of Status of Refugees",
    "210": "Special Agricultural Workers",
    "211": "Reentry Permits",
    "212": "Documentary Requirements / Grounds of Inadmissibility",
    "213": "Bonding Requirements",
    "214": "Nonimmigrant Classes",
    "215": "Controls of Aliens Departing",
    "216": "Conditional Permanent Residence",
    "235": "Inspection of Persons Applying for Admission",
    "240": "Removal Proceedings",
    "241": "Apprehension and Detention",
    "244": "Temporary Protected Status",
    "245": "Adjustment of Status",
    "245a": "Legalization of Undocumented Aliens",
    "248": "Change of Nonimmigrant Classification",
    "264": "Registration",
    "270": "Penalties for Unlawful Employment",
    "274a": "Control of Employment of Aliens",
    "292": "Representation and Appearances",
    "316": "General Requirements for Naturalization",
    "319": "Special Classes of Persons — Naturalization",
    "655": "H-2A / H-2B Temporary Worker Certifications",
    "656": "PERM Labor Certification",
    "40": "Visas: Grounds of Inadmissibility",
    "41": "Visas: Nonimmigrant Visas",
    "42": "Visas: Immigrant Visas",
    "62": "Exchange Visitor Program",
}
_FILE = "(?iU)^(\\d+)\\s+CFR\\s+Part\\s+(\\w+).*?(\\d{1,2}[-/]\\d{1,2}[-/]\\d{4})"
_SECTION = "(?U)§\\s*(\\d+\\w*\\.\\d+\\w*)\\s+(.+?)(?:\\n|$)"
_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{1,2},\\s+(\\d{4})"


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def regulation_file(name: Column) -> Column:
    """Struct (cfr_title, cfr_part, as_of_date, agency, part_name, title) of a file name; other names give a title alone."""
    number, part = _group(name, _FILE).cast("int"), F.lower(_group(name, _FILE, 2))
    names = F.create_map(*(F.lit(x) for entry in PARTS.items() for x in entry))
    agency = F.when(number.isNotNull(), F.coalesce(*(F.when(number == n, a) for n, a in AGENCIES), F.lit("Federal")))
    date = F.to_date(F.try_to_timestamp(F.replace(_group(name, _FILE, 3), F.lit("/"), F.lit("-")), F.lit("M-d-yyyy")))
    title = F.coalesce(F.concat(number.cast("string"), F.lit(" CFR Part "), _group(name, _FILE, 2)), F.regexp_replace(name, "\\.[^.]*$", ""))
    return F.struct(number.alias("cfr_title"), part.alias("cfr_part"), date.alias("as_of_date"), agency.alias("agency"), F.try_element_at(names, part).alias("part_name"), title.alias("title"))


def section_index(docs: DataFrame, key: str, text: str, within: int | None = None) -> DataFrame:
    """(key, section, title, position): each section's first title, of at most 120 characters. ``within`` cuts texts as the original index does."""
    body = F.col(text) if within is None else F.substring(text, 1, within)
    found = docs.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(body, F.lit(_SECTION), F.lit(1)).alias("section"), F.regexp_extract_all(body, F.lit(_SECTION), F.lit(2)).alias("title"))).alias("position", "s"))
    return found.groupBy(key, F.col("s.section").alias("section")).agg(F.min_by(F.substring(F.trim("s.title"), 1, 120), "position").alias("title"), F.min("position").alias("position"))


def chunk_citation(chunk: Column, cfr_title: Column, document: Column) -> Column:
    """"8 CFR 214.2" of the first section that a chunk names, else the document's citation."""
    section = _group(chunk, "§\\s*(\\d+\\.\\d+[\\w.]*)")
    return F.coalesce(F.concat(cfr_title.cast("string"), F.lit(" CFR "), section), document)


def notice_tag(doc_type: Column, outcome: Column, text: Column) -> Column:
    """The document's type, or docketing_notice for decisions without an outcome that say so."""
    says = F.coalesce(text.ilike("%NOTICE OF DOCKETING, BRIEFING SCHEDULE%"), F.lit(False))
    return F.when((doc_type == "decision") & outcome.isNull() & says, "docketing_notice").otherwise(doc_type)


def adopted_decision(head: Column, name: Column) -> Column:
    """Struct (party_name, adopted_num, pm_number, year, citation) of the first pages of an adopted decision and its file's name."""
    subject = "(?i)SUBJECT[:\\s]+Matter of ([^,\\n]+?)(?:,\\s*Adopted Decision\\s*(\\d{4}-\\d+))?(?:\\s*\\(AAO|\\s*\\n)"
    party = F.coalesce(F.nullif(F.trim(_group(head, subject)), F.lit("")), F.nullif(F.trim(_group(head, "Matter of ([^(]+)\\s*\\(")), F.lit("")), name)
    number, memo = _group(head, subject, 2), _group(head, "PM-602-\\d+", 0)
    year = _group(head, _MONTH, 2).cast("int")
    citation = F.concat(F.lit("Adopted "), F.coalesce(number, memo, name))
    return F.struct(party.alias("party_name"), number.alias("adopted_num"), memo.alias("pm_number"), year.alias("year"), citation.alias("citation"))


def precedent_entry(line: Column) -> Column:
    """Struct (volume, page, citation, party_name, year, body) of a line of the precedent list; null without a citation."""
    cite = "(?i)(\\d+)\\s*I&(?:amp;)?N\\s*Dec\\.?\\s*(\\d+)"
    volume, page = _group(line, cite).cast("int"), _group(line, cite, 2)
    party = F.btrim(collapse(F.regexp_extract(line, "(?is)^(.*?)\\d+\\s*I&(?:amp;)?N\\s*Dec\\.?\\s*\\d+", 1)), F.lit(".,* "))
    place = "\\(([^)]+?)\\s+(\\d{4})\\)"
    entry = F.struct(
        volume.alias("volume"), page.alias("page"), F.concat(volume.cast("string"), F.lit(" I&N Dec. "), page).alias("citation"), F.substring(party, 1, 200).alias("party_name"),
        _group(line, place, 2).cast("int").alias("year"), F.substring(F.trim(F.regexp_extract(line, place, 1)), 1, 100).alias("body"))
    return F.when(page.isNotNull(), entry)


def precedent_keys(citation: Column, decision_type: Column, adopted_num: Column) -> Column:
    """Every way a text may name a precedent: its citation, also as a scan misreads it, and the adopted number, also with hard spaces."""
    cite = _group(citation, "(\\d+ I&N Dec\\. \\d+)")
    adopted = F.when(decision_type == "adopted", F.concat(F.lit("Adopted Decision "), F.nullif(adopted_num, F.lit(""))))
    return F.array_compact(F.array(cite, F.replace(cite, F.lit("I&N"), F.lit("l&N")), adopted, F.replace(adopted, F.lit(" "), F.lit("\xa0"))))
