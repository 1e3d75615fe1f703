"""The queries of this subpackage, and their SQL where SQL can express them."""

from linkspan.llm import ngram_join, quality, secrets
from linkspan.llm.decontamination import op5_template_decontamination
from linkspan.llm.html_extraction import op1_page_differencing
from linkspan.llm.language_id import op6_rank_order_language_id
from linkspan.llm.lm_scoring import op7_cross_entropy_difference
from linkspan.llm.ngram_join import op3_multi_order_ngram_join
from linkspan.llm.packing import op10_bm25_packing
from linkspan.llm.pii import op9_bootstrapped_pii
from linkspan.llm.quality import op2_line_frequency_quality
from linkspan.llm.secrets import op4_ownership_secrets
from linkspan.llm.sharding import op8_vector_bin_sharding

QUERIES = {
    "op1_page_differencing": op1_page_differencing,
    "op2_line_frequency_quality": op2_line_frequency_quality,
    "op3_multi_order_ngram_join": op3_multi_order_ngram_join,
    "op4_ownership_secrets": op4_ownership_secrets,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_rank_order_language_id": op6_rank_order_language_id,
    "op7_cross_entropy_difference": op7_cross_entropy_difference,
    "op8_vector_bin_sharding": op8_vector_bin_sharding,
    "op9_bootstrapped_pii": op9_bootstrapped_pii,
    "op10_bm25_packing": op10_bm25_packing,
}

ORACLES: dict[str, str] = {
    "op2_line_frequency_quality": quality.ORACLE,
    "op3_multi_order_ngram_join": ngram_join.ORACLE,
    "op4_ownership_secrets": secrets.ORACLE,
}
