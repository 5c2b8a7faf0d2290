"""The registered opN_ queries and their DuckDB SQL, where SQL can express them."""

from quern.llm.exact_dedup import ORACLE_OP5, op5_exact_dedup
from quern.llm.language_id import op4_language_id
from quern.llm.line_dedup import ORACLE_OP10, op10_line_dedup
from quern.llm.minhash import ORACLE_OP7, op7_minhash_dedup
from quern.llm.packing import op1_best_fit_packing
from quern.llm.piece_codec import op9_sentencepiece
from quern.llm.secret_scan import op3_secret_scan
from quern.llm.suffix_dedup import op6_suffix_dedup
from quern.llm.url_filter import op8_url_filter
from quern.llm.vector_search import op2_vector_search

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_vector_search": op2_vector_search,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES = {
    "op5_exact_dedup": ORACLE_OP5,
    "op7_minhash_dedup": ORACLE_OP7,
    "op10_line_dedup": ORACLE_OP10,
}
