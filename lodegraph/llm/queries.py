"""The queries of this subpackage and, where SQL can express them whole, their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .decontaminate import op3_decontaminate
from .fertility import op10_fertility
from .jaccard import op8_jaccard
from .langid import op1_langid
from .lmscore import op6_lm_score
from .pii import op4_pii
from .quality import op2_quality
from .substring import op5_substring
from .sql import DECONTAMINATE, JACCARD, SUBSTRING
from .wordpiece import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_langid, op2_quality, op3_decontaminate, op4_pii, op5_substring, op6_lm_score, op7_bpe, op8_jaccard, op9_token_counts, op10_fertility)}
ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE, "op5_substring": SUBSTRING, "op8_jaccard": JACCARD}
