"""The queries of this subpackage, by name."""

from __future__ import annotations

from corpusloom.llm import centroid_clustering, collocations, embedding_neardup, jaccard_join, sharding
from corpusloom.llm.centroid_clustering import op11_centroid_clustering
from corpusloom.llm.collocations import op13_collocations
from corpusloom.llm.embedding_neardup import op4_embedding_neardup
from corpusloom.llm.html_extraction import op9_html_extraction
from corpusloom.llm.jaccard_join import op3_ngram_jaccard_join
from corpusloom.llm.lm_scoring import op8_lm_scoring
from corpusloom.llm.packing import op7_best_fit_packing
from corpusloom.llm.quality_classifier import op1_quality_classifier
from corpusloom.llm.quality_rules import op6_quality_rules
from corpusloom.llm.sentencepieces import op5_sentencepiece
from corpusloom.llm.sharding import op12_stratified_sharding
from corpusloom.llm.token_counts import op2_token_counts
from corpusloom.llm.token_output import op10_token_output


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_token_counts, op3_ngram_jaccard_join, op4_embedding_neardup, op5_sentencepiece, op6_quality_rules, op7_best_fit_packing, op8_lm_scoring, op9_html_extraction, op10_token_output, op11_centroid_clustering, op12_stratified_sharding, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express; the others are compared with brute force in tests/llm."""
    return {"op3_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op4_embedding_neardup": embedding_neardup.ORACLE_SQL, "op11_centroid_clustering": centroid_clustering.ORACLE_SQL, "op12_stratified_sharding": sharding.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
