"""The training-data queries, by the name under which they are registered."""

from __future__ import annotations

from graphfold.llm import oracles
from graphfold.llm.ann import exact_neighbours, op10_nearest
from graphfold.llm.bpe import op3_bpe_round_trip
from graphfold.llm.flac import media_payload, op4_flac_media
from graphfold.llm.langid import op6_language_id
from graphfold.llm.mixing import mixing_tokens, op8_mixing
from graphfold.llm.negatives import op13_negatives
from graphfold.llm.ngram_join import op5_ngram_join
from graphfold.llm.packing import op11_packing
from graphfold.llm.phrases import op12_phrases
from graphfold.llm.quality import op1_quality
from graphfold.llm.secrets import base_secrets, op7_secret_scan
from graphfold.llm.suffix_dedup import op9_suffix_dedup
from graphfold.llm.urls import op2_url_filter, url_rules

QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_flac_media": op4_flac_media,
    "op5_ngram_join": op5_ngram_join,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_nearest": op10_nearest,
    "op11_packing": op11_packing,
    "op12_phrases": op12_phrases,
    "op13_negatives": op13_negatives,
    # the parts of op7, op2, op4 and op8 that no model or format decides, and what op10 is measured against
    "base_secrets": base_secrets,
    "url_rules": url_rules,
    "media_payload": media_payload,
    "mixing_tokens": mixing_tokens,
    "exact_neighbours": exact_neighbours,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL = {
    "op5_ngram_join": oracles.NGRAM_JOIN,
    "op9_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op12_phrases": oracles.PHRASES,
    "op13_negatives": oracles.NEGATIVES,
    "base_secrets": oracles.BASE_SECRETS,
    "url_rules": oracles.URL_RULES,
    "media_payload": oracles.MEDIA_PAYLOAD,
    "mixing_tokens": oracles.MIXING_TOKENS,
    "exact_neighbours": oracles.EXACT_NEIGHBOURS,
}
