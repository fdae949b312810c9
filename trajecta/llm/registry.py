"""The registered corpus queries."""

from __future__ import annotations

from .conversations import ORACLE_SQL as CONVERSATIONS_SQL
from .conversations import op11_repair_conversations
from .decontaminate import op6_decontaminate
from .htmltext import op9_extract_html
from .langid import op10_language
from .lmscore import op7_lm_score
from .manifest import ORACLE_SQL as MANIFEST_SQL
from .manifest import op12_merkle_manifest
from .mixing import op1_mix_sources
from .nearest import op4_nearest
from .neardup import ORACLE_SQL as NEARDUP_SQL
from .neardup import op8_near_duplicates
from .packing import op13_pack_documents
from .pii import op3_pii
from .tokencounts import op5_token_counts
from .urlfilter import op2_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op3_pii": op3_pii,
    "op4_nearest": op4_nearest,
    "op5_token_counts": op5_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_extract_html": op9_extract_html,
    "op10_language": op10_language,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pack_documents": op13_pack_documents,
}

ORACLE_SQL: dict[str, str] = {
    "op8_near_duplicates": NEARDUP_SQL,
    "op11_repair_conversations": CONVERSATIONS_SQL,
    "op12_merkle_manifest": MANIFEST_SQL,
}
