"""The corpus operators' queries, by name, with SQL where SQL can express them."""

from __future__ import annotations

from lodeline.llm import decontaminate, linededup, mixing
from lodeline.llm.decontaminate import op9_decontaminate
from lodeline.llm.htmltext import op8_html_text
from lodeline.llm.licenses import op4_license_scan
from lodeline.llm.linededup import op5_line_dedup
from lodeline.llm.mixing import op3_mix_sources
from lodeline.llm.pii import op10_pii
from lodeline.llm.quality import op2_quality_crf
from lodeline.llm.rules import op7_quality_rules
from lodeline.llm.simhash import op6_simhash_near_dedup
from lodeline.llm.sstable import op1_token_sstable

QUERIES = {
    "op1_token_sstable": op1_token_sstable,
    "op2_quality_crf": op2_quality_crf,
    "op3_mix_sources": op3_mix_sources,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": linededup.ORACLE_SQL,
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
}
