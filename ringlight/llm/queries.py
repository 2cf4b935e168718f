"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontaminate import op6_decontaminate
from .langid import op2_language
from .licenses import SQL as LICENSES_SQL
from .licenses import op4_licenses
from .lm import op9_language_model
from .pieces import op3_token_counts
from .pii import op8_pii
from .quality import SQL as QUALITY_SQL
from .quality import op5_quality
from .simhash import op7_simhash
from .substrings import op10_substrings

QUERIES = {f.__name__: f for f in (op1_bpe, op2_language, op3_token_counts, op4_licenses, op5_quality, op6_decontaminate, op7_simhash, op8_pii, op9_language_model, op10_substrings)}
ORACLE_SQL: dict[str, str] = {"op4_licenses": LICENSES_SQL, "op5_quality": QUALITY_SQL}
