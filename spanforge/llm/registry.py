"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op6_approximate_nearest_neighbours
from .ball_kmeans import OP12_SQL, op12_ball_kmeans
from .bpe import op10_bpe_encoding_and_decoding
from .embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import op4_mixing_sources
from .ngram_join import OP7_SQL, op7_ngram_jaccard_join
from .quality import op3_quality_classifier
from .sharding import op5_sharding
from .spelling import OP13_SQL, op13_spelling_variants
from .suffix_dedup import OP9_SQL, op9_suffix_array_dedup
from .token_counts import op1_token_counts
from .url_filter import OP11_SQL, op11_url_filters


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_mixing_sources": op4_mixing_sources,
        "op5_sharding": op5_sharding,
        "op6_approximate_nearest_neighbours": op6_approximate_nearest_neighbours,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_bpe_encoding_and_decoding": op10_bpe_encoding_and_decoding,
        "op11_url_filters": op11_url_filters,
        "op12_ball_kmeans": op12_ball_kmeans,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql():
    return {"op2_embedding_near_dedup": OP2_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_suffix_array_dedup": OP9_SQL, "op11_url_filters": OP11_SQL, "op12_ball_kmeans": OP12_SQL, "op13_spelling_variants": OP13_SQL}
