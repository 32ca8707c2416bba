"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from plotline.llm.chat_format import OP3_SQL, op3_chat_format
from plotline.llm.clustering import OP13_SQL, op13_centroid_clustering
from plotline.llm.decontaminate import OP9_SQL, op9_decontaminate
from plotline.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from plotline.llm.html_extract import op6_html_extract
from plotline.llm.ngram_join import op1_ngram_join
from plotline.llm.piece_sampling import op8_piece_sampling
from plotline.llm.quality_classifier import op4_quality_classifier
from plotline.llm.secret_scan import op2_secret_scan
from plotline.llm.sharding import op7_sharding
from plotline.llm.substring_dedup import op5_substring_dedup
from plotline.llm.token_counts import op12_token_counts
from plotline.llm.topk_search import OP10_SQL, op10_topk_search

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_sharding": op7_sharding,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_decontaminate": op9_decontaminate,
    "op10_topk_search": op10_topk_search,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_topk_search": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
