"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from fieldloom.llm.bpe import op10_bpe
from fieldloom.llm.fingerprint import op9_fingerprint
from fieldloom.llm.langid import op1_language
from fieldloom.llm.mtree import op3_topk
from fieldloom.llm.packing import op2_packing
from fieldloom.llm.setjoin import op8_jaccard_join
from fieldloom.llm.sharding import op5_shard
from fieldloom.llm.toxicity import op6_toxicity
from fieldloom.llm.urlfilter import OP4_SQL, op4_url_filter
from fieldloom.llm.warc import op7_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_url_filter": op4_url_filter,
    "op5_shard": op5_shard,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprint": op9_fingerprint,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {"op4_url_filter": OP4_SQL}
