"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliosift.llm.decontaminate import op2_decontamination
from foliosift.llm import infill, licenses, urlfilters
from foliosift.llm.imagecopies import op4_image_copies
from foliosift.llm.language import op6_language
from foliosift.llm.nearset import op10_near_duplicates
from foliosift.llm.packing import op5_packing
from foliosift.llm.periodic import op11_runs
from foliosift.llm.resharding import op7_resharding
from foliosift.llm.secrets import op1_secrets
from foliosift.llm.simhash import op13_simhash
from foliosift.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": licenses.op3_licenses,
    "op4_image_copies": op4_image_copies,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_resharding": op7_resharding,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": urlfilters.op9_url_filters,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_runs": op11_runs,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_simhash": op13_simhash,
}

ORACLES: dict[str, str] = {"op3_licenses": licenses.ORACLE, "op9_url_filters": urlfilters.ORACLE, "op12_fill_in_middle": infill.ORACLE}
