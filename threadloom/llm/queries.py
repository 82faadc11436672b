"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat import OP8_SQL, op8_chat
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language import op11_language
from .lines import op4_lines
from .merkle import OP12_SQL, op12_merkle
from .packing import op7_packing
from .prefix_trie import OP13_SQL, op13_trie
from .quality import op6_quality
from .repeats import op9_repeats
from .simhash import op5_simhash
from .token_store import op2_token_store
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_store, op3_exact_dedup, op4_lines, op5_simhash, op6_quality, op7_packing, op8_chat, op9_repeats, op10_toxicity, op11_language, op12_merkle, op13_trie)}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op8_chat": OP8_SQL, "op12_merkle": OP12_SQL, "op13_trie": OP13_SQL}
