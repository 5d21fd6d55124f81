"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from gridlore.llm.bpe import op1_bpe
from gridlore.llm.chat import OP4_SQL, op4_chat_format
from gridlore.llm.decontaminate import op6_decontamination
from gridlore.llm.divergence import OP12_SQL, op12_source_divergence
from gridlore.llm.langid import op9_language_id
from gridlore.llm.lexical import OP11_SQL, op11_ranked_search
from gridlore.llm.licenses import OP13_SQL, op13_license_scan
from gridlore.llm.linededup import op3_line_dedup
from gridlore.llm.pii import op2_pii
from gridlore.llm.quality import op5_quality_rules
from gridlore.llm.shards import op8_training_order
from gridlore.llm.simhash import op7_simhash
from gridlore.llm.siteprior import op10_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_pii,
        op3_line_dedup,
        op4_chat_format,
        op5_quality_rules,
        op6_decontamination,
        op7_simhash,
        op8_training_order,
        op9_language_id,
        op10_quality,
        op11_ranked_search,
        op12_source_divergence,
        op13_license_scan,
    )
}
ORACLE_SQL = {
    "op4_chat_format": OP4_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
