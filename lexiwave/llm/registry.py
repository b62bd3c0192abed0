"""Queries of the subpackage by name, and the SQL of those that SQL can express."""

from lexiwave.llm.bpe import op10_byte_bpe
from lexiwave.llm.chat_format import OP13_SQL, op13_chat_format
from lexiwave.llm.embedding_dedup import op2_embedding_dedup
from lexiwave.llm.language_id import op9_language_id
from lexiwave.llm.licences import op5_licence_scan
from lexiwave.llm.line_dedup import OP7_SQL, PAGES_SQL, op7_line_dedup, page_lines
from lexiwave.llm.mixing import op8_mix_sources
from lexiwave.llm.near_dedup import op4_near_dedup
from lexiwave.llm.quality import op1_quality_rules
from lexiwave.llm.secrets import op6_secret_scan
from lexiwave.llm.substring_dedup import op3_substring_dedup
from lexiwave.llm.turn_repair import OP12_SQL, op12_turn_repair
from lexiwave.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_licence_scan": op5_licence_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "line_dedup_pages": page_lines,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_turn_repair": op12_turn_repair,
    "op13_chat_format": op13_chat_format,
}
SQL = {"op7_line_dedup": OP7_SQL, "line_dedup_pages": PAGES_SQL, "op11_vector_codes": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_chat_format": OP13_SQL}
