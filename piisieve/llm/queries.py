"""The registered queries of the operators, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from piisieve.llm.bpe import op4_bpe
from piisieve.llm.conversations import op13_conversation_repair
from piisieve.llm.fingerprints import op9_fingerprints
from piisieve.llm.licenses import op11_license_scans
from piisieve.llm.lm_scoring import op1_lm_scoring
from piisieve.llm.packing import op7_packing
from piisieve.llm.periodic_runs import op12_periodic_runs
from piisieve.llm.quality_classifier import op6_quality_classifier
from piisieve.llm.quality_rules import op5_quality_rules
from piisieve.llm.simhash import op2_simhash
from piisieve.llm.substrings import op3_substrings
from piisieve.llm.token_counts import op8_token_counts
from piisieve.llm.url_filters import OP10_SQL, op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_filters": op10_url_filters,
    "op11_license_scans": op11_license_scans,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op10_url_filters": OP10_SQL}
