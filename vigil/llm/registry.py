"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from vigil.llm import (credentials, decontaminate, licenses, lines, minhash, mixing, neighbours, quality, repeats,
                       search, tokens, toxicity, trie)

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_quality": quality.op2_quality,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_licenses": licenses.op4_licenses,
    "op5_tokens": tokens.op5_tokens,
    "op6_minhash": minhash.op6_minhash,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_lines": lines.op9_lines,
    "op10_mixing": mixing.op10_mixing,
    "op11_search": search.op11_search,
    "op12_trie": trie.op12_trie,
    "op13_secrets": credentials.op13_secrets,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op4_licenses": licenses.ORACLE_SQL,
    "op6_minhash": minhash.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_search": search.ORACLE_SQL,
    "op12_trie": trie.ORACLE_SQL,
}
