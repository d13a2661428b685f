"""The queries of this subpackage and the SQL that checks them, for the driver's entry module."""

from __future__ import annotations

from annealjobs.llm import chat_format, divergence, licenses, manifest, mixing, url_filter
from annealjobs.llm.chat_format import op5_chat_format
from annealjobs.llm.decontaminate import op9_decontamination
from annealjobs.llm.divergence import op12_source_divergence
from annealjobs.llm.language_id import op3_language_id
from annealjobs.llm.licenses import op13_license_scans
from annealjobs.llm.manifest import op11_merkle_manifest
from annealjobs.llm.mixing import op6_mixing
from annealjobs.llm.quality import op8_quality_rules
from annealjobs.llm.simhash import op1_simhash
from annealjobs.llm.suffix_dedup import op7_suffix_dedup
from annealjobs.llm.token_counts import op10_token_counts
from annealjobs.llm.token_output import op4_token_output
from annealjobs.llm.url_filter import op2_url_filters

QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filters, op3_language_id, op4_token_output, op5_chat_format, op6_mixing, op7_suffix_dedup, op8_quality_rules, op9_decontamination, op10_token_counts, op11_merkle_manifest, op12_source_divergence, op13_license_scans)}
#: The others can't be put in SQL, and are tested against brute force in tests/llm.
ORACLES = {"op2_url_filters": url_filter.oracle(), "op5_chat_format": chat_format.ORACLE, "op6_mixing": mixing.ORACLE, "op11_merkle_manifest": manifest.oracle(), "op12_source_divergence": divergence.ORACLE, "op13_license_scans": licenses.oracle()}
