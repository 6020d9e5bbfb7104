"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, license_scan, quality, sentencepiece, simhash, suffix_array, surrogates, toxicity, url_filter, warc_revisit

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"op1_decontamination": decontaminate.op1_decontamination, "op2_warc_revisit": warc_revisit.op2_warc_revisit, "op3_toxicity": toxicity.op3_toxicity, "op4_sentencepiece": sentencepiece.op4_sentencepiece, "op5_simhash": simhash.op5_simhash, "op6_quality_rules": quality.op6_quality_rules, "op7_suffix_array": suffix_array.op7_suffix_array, "op8_surrogates": surrogates.op8_surrogates, "op9_license_scan": license_scan.op9_license_scan, "op10_url_filter": url_filter.op10_url_filter}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisit": warc_revisit.ORACLE, "op9_license_scan": license_scan.ORACLE, "op10_url_filter": url_filter.ORACLE}
