"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP10_SQL, op10_tool_calls
from .exact_digest import op8_exact_digest
from .langid import op4_language_id
from .mixing import op2_mixing
from .multi_index import op3_multi_index
from .packing import op5_packing
from .pii import op6_pii
from .simhash import op9_simhash
from .suffix_dedup import op1_suffix_dedup
from .warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_multi_index, op4_language_id, op5_packing, op6_pii, op7_warc, op8_exact_digest, op9_simhash, op10_tool_calls)}

#: The others are learned, iterated, or hash by functions that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op7_warc": OP7_SQL, "op10_tool_calls": OP10_SQL}
