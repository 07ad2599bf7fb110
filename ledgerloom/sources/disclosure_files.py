"""Disclosure files of three programs: all-text scan, headers, target columns, and indexes of documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce_date, coerce_int, coerce_num, coerce_str
from ..functions.extract import fiscal_year
from ..operators.upsert import keep_first

# Target column and the headers that it is read from, the first that is not blank. ``fiscal_year`` and ``source_file`` join them.
MAPS: dict[str, dict[str, tuple[str, ...]]] = {
    "perm": {
        "case_number": ("CASE_NUMBER",),
        "case_status": ("CASE_STATUS",),
        "received_date": ("RECEIVED_DATE",),
        "decision_date": ("DECISION_DATE",),
        "occupation_type": ("OCCUPATION_TYPE",),
        "employer_name": ("EMP_BUSINESS_NAME",),
        "employer_state": ("EMP_STATE",),
        "employer_city": ("EMP_CITY",),
        "employer_postal_code": ("EMP_POSTCODE",),
        "employer_fein": ("EMP_FEIN",),
        "employer_naics": ("EMP_NAICS",),
        "employer_num_payroll": ("EMP_NUM_PAYROLL",),
        "employer_year_commenced": ("EMP_YEAR_COMMENCED",),
        "atty_law_firm": ("ATTY_AG_LAW_FIRM_NAME",),
        "atty_last_name": ("ATTY_AG_LAST_NAME",),
        "atty_first_name": ("ATTY_AG_FIRST_NAME",),
        "atty_state": ("ATTY_AG_STATE",),
        "job_title": ("JOB_TITLE",),
        "soc_code": ("PWD_SOC_CODE",),
        "soc_title": ("PWD_SOC_TITLE",),
        "wage_from": ("JOB_OPP_WAGE_FROM",),
        "wage_to": ("JOB_OPP_WAGE_TO",),
        "wage_per": ("JOB_OPP_WAGE_PER",),
        "worksite_city": ("PRIMARY_WORKSITE_CITY",),
        "worksite_state": ("PRIMARY_WORKSITE_STATE",),
        "worksite_postal_code": ("PRIMARY_WORKSITE_POSTAL_CODE",),
        "worksite_bls_area": ("PRIMARY_WORKSITE_BLS_AREA",),
        "pwd_number": ("JOB_OPP_PWD_NUMBER",),
        "fw_currently_employed": ("OTHER_REQ_IS_FW_CURRENTLY_WRK",),
        "is_multiple_locations": ("IS_MULTIPLE_LOCATIONS",),
        "employer_layoff": ("OTHER_REQ_EMP_LAYOFF",),
    },
    "lca": {
        "case_number": ("CASE_NUMBER",),
        "case_status": ("CASE_STATUS",),
        "visa_class": ("VISA_CLASS",),
        "received_date": ("RECEIVED_DATE",),
        "decision_date": ("DECISION_DATE",),
        "begin_date": ("BEGIN_DATE",),
        "end_date": ("END_DATE",),
        "employer_name": ("EMPLOYER_NAME",),
        "employer_state": ("EMPLOYER_STATE",),
        "employer_city": ("EMPLOYER_CITY",),
        "employer_postal_code": ("EMPLOYER_POSTAL_CODE",),
        "employer_fein": ("EMPLOYER_FEIN",),
        "naics_code": ("NAICS_CODE",),
        "law_firm_name": ("LAWFIRM_NAME_BUSINESS_NAME",),
        "agent_last_name": ("AGENT_ATTORNEY_LAST_NAME",),
        "agent_first_name": ("AGENT_ATTORNEY_FIRST_NAME",),
        "agent_state": ("AGENT_ATTORNEY_STATE",),
        "job_title": ("JOB_TITLE",),
        "soc_code": ("SOC_CODE",),
        "soc_title": ("SOC_TITLE",),
        "full_time_position": ("FULL_TIME_POSITION",),
        "total_worker_positions": ("TOTAL_WORKER_POSITIONS",),
        "wage_from": ("WAGE_RATE_OF_PAY_FROM",),
        "wage_to": ("WAGE_RATE_OF_PAY_TO",),
        "wage_unit": ("WAGE_UNIT_OF_PAY",),
        "prevailing_wage": ("PREVAILING_WAGE",),
        "pw_unit": ("PW_UNIT_OF_PAY",),
        "pw_wage_level": ("PW_WAGE_LEVEL",),
        "pw_oes_year": ("PW_OES_YEAR",),
        "worksite_city": ("WORKSITE_CITY",),
        "worksite_state": ("WORKSITE_STATE",),
        "worksite_postal_code": ("WORKSITE_POSTAL_CODE",),
        "h1b_dependent": ("H_1B_DEPENDENT",),
        "willful_violator": ("WILLFUL_VIOLATOR",),
    },
    "pw": {
        "case_number": ("CASE_NUMBER",),
        "case_status": ("CASE_STATUS",),
        "visa_class": ("VISA_CLASS",),
        "received_date": ("RECEIVED_DATE",),
        "determination_date": ("DETERMINATION_DATE", "PREVAIL_WAGE_DETERM_DATE"),
        "employer_name": ("EMPLOYER_LEGAL_BUSINESS_NAME", "EMPLOYER_NAME"),
        "employer_state": ("EMPLOYER_STATE",),
        "employer_city": ("EMPLOYER_CITY",),
        "employer_postal_code": ("EMPLOYER_POSTAL_CODE",),
        "employer_fein": ("EMPLOYER_FEIN",),
        "naics_code": ("NAICS_CODE",),
        "law_firm_name": ("LAWFIRM_NAME_BUSINESS_NAME",),
        "agent_last_name": ("AGENT_ATTORNEY_LAST_NAME",),
        "agent_first_name": ("AGENT_ATTORNEY_FIRST_NAME",),
        "job_title": ("JOB_TITLE",),
        "soc_code": ("PWD_SOC_CODE", "SUGGESTED_SOC_CODE"),
        "soc_title": ("PWD_SOC_TITLE", "SUGGESTED_SOC_TITLE"),
        "suggested_soc_code": ("SUGGESTED_SOC_CODE",),
        "suggested_soc_title": ("SUGGESTED_SOC_TITLE",),
        "pwd_soc_code": ("PWD_SOC_CODE",),
        "pwd_soc_title": ("PWD_SOC_TITLE",),
        "o_net_code": ("O_NET_CODE", "O_NET_CODE_COMBO"),
        "o_net_title": ("O_NET_TITLE", "O_NET_TITLE_COMBO"),
        "emp_soc_codes": ("EMP_SOC_CODES",),
        "emp_soc_titles": ("EMP_SOC_TITLES",),
        "pwd_wage_rate": ("PWD_WAGE_RATE", "H2B_HIGHEST_PWD"),
        "pwd_unit": ("PWD_UNIT_OF_PAY",),
        "pw_wage_level": ("PWD_OES_WAGE_LEVEL",),
        "wage_source": ("PWD_WAGE_SOURCE",),
        "wage_source_requested": ("WAGE_SOURCE_REQUESTED",),
        "survey_name": ("SURVEY_NAME", "PWD_SURVEY_NAME"),
        "bls_area": ("BLS_AREA",),
        "pwd_wage_expiration_date": ("PWD_WAGE_EXPIRATION_DATE",),
        "alt_pwd_wage_rate": ("ALT_PWD_WAGE_RATE",),
        "alt_pwd_unit": ("ALT_PWD_UNIT_OF_PAY",),
        "alt_pwd_wage_level": ("ALT_PWD_OES_WAGE_LEVEL",),
        "alt_pwd_wage_source": ("ALT_PWD_WAGE_SOURCE",),
        "worksite_city": ("PRIMARY_WORKSITE_CITY",),
        "worksite_state": ("PRIMARY_WORKSITE_STATE",),
        "worksite_postal_code": ("PRIMARY_WORKSITE_POSTAL_CODE",),
    },
}
_NUMBERS = frozenset({"wage_from", "wage_to", "prevailing_wage", "pwd_wage_rate", "alt_pwd_wage_rate"})
_WHOLE = frozenset({"employer_num_payroll", "employer_year_commenced", "total_worker_positions"})


def normalised(raw: DataFrame) -> DataFrame:
    """Headers stripped and in capitals; of headers that become equal the first one stays."""
    names = [c.strip().upper() for c in raw.columns]
    renamed = raw.toDF(*(f"{i}" for i in range(len(names))))
    return renamed.select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate(names) if n not in names[:i]))


def map_program(raw: DataFrame, program: str) -> DataFrame:
    """All-text rows as a program's target columns; absent headers give nulls, rows with a blank case number go."""
    df = normalised(raw)

    def column(target: str, *sources: str) -> Column:
        cells = [F.when(~F.trim(F.col(f"`{s}`")).isin("", "nan", "NaT"), F.col(f"`{s}`")) for s in sources if s in df.columns]
        cell = F.coalesce(*cells) if cells else F.lit(None).cast("string")
        coerced = coerce_date if target.endswith("_date") else coerce_num if target in _NUMBERS else coerce_int if target in _WHOLE else coerce_str
        return coerced(cell).alias(target)

    more = [c for c in ("fiscal_year", "source_file") if c.upper() in df.columns]
    return df.select(*(F.col(c.upper()).alias(c) for c in more), *(column(target, *sources) for target, sources in MAPS[program].items())).where("case_number IS NOT NULL")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A file that is split over tasks, unless a line of it opens a quote that it doesn't close: then a cell goes on over lines, and one task reads it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    open_ = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=open_, escape='"')


def read_program(spark: SparkSession, paths: Sequence[str], program: str) -> DataFrame:
    """Files of one program, each with its own header; the year is its folder's, the file's name goes along. Without files: no rows."""
    at = F.col("_metadata.file_path")
    parts = [_csv(spark, p).select("*", fiscal_year(at).alias("FISCAL_YEAR"), F.substring_index(at, "/", -1).alias("SOURCE_FILE")) for p in paths]
    if not parts:
        return map_program(spark.createDataFrame([], "CASE_NUMBER string, FISCAL_YEAR string, SOURCE_FILE string"), program)
    return reduce(DataFrame.unionByName, (map_program(p, program) for p in parts))


def first_by_file(index: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Rows of an index of documents, cells stripped: the first of each file name, none where it is blank."""
    cells = index.select(*(F.trim(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in index.dtypes))
    return keep_first(cells.where(F.coalesce(F.col(name), F.lit("")) != ""), [name], order)
