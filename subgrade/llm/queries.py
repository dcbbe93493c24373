"""The subpackage's queries by name, and their SQL where SQL can express them."""

from subgrade.llm.backoff import OP7_SQL, op7_lm_scoring
from subgrade.llm.maintext import op13_html_extraction
from subgrade.llm.packing import op8_best_fit_packing
from subgrade.llm.pieces import op1_sentencepiece
from subgrade.llm.prefixtrie import OP11_SQL, op11_prefix_trie
from subgrade.llm.repair import OP12_SQL, op12_conversation_repair
from subgrade.llm.rules import op9_quality_rules
from subgrade.llm.sharding import op10_sharding
from subgrade.llm.simhash import op6_simhash_near_dedup
from subgrade.llm.substrings import op3_substring_dedup
from subgrade.llm.topk import OP5_SQL, op5_top_k_search
from subgrade.llm.weaklabels import op4_quality_classifier
from subgrade.llm.wordpieces import op2_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_top_k_search": op5_top_k_search,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_html_extraction": op13_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op5_top_k_search": OP5_SQL,
    "op7_lm_scoring": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
