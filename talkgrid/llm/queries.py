"""The registered queries of this subpackage and, where SQL can express one, the SQL it must agree with."""

from .alignment import op13_query
from .binary import op8_query
from .chat import op1_query
from .exactdedup import OP10_SQL, op10_query
from .hardneg import OP11_SQL, op11_query
from .importance import op9_query
from .jaccard import op12_query
from .mixing import op7_query
from .neardedup import op5_query
from .pieces import op3_query
from .pii import op2_query
from .toxicity import op6_query
from .vptree import op4_query

QUERIES = {
    "op1_chat_format": op1_query,
    "op2_pii": op2_query,
    "op3_sentencepiece": op3_query,
    "op4_vantage_trees": op4_query,
    "op5_minhash": op5_query,
    "op6_toxicity": op6_query,
    "op7_mixing": op7_query,
    "op8_arrow_sequences": op8_query,
    "op9_importance": op9_query,
    "op10_exact_dedup": op10_query,
    "op11_hard_negatives": op11_query,
    "op12_jaccard_join": op12_query,
    "op13_token_alignment": op13_query,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
}
