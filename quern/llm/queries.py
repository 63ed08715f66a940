"""Queries of the corpus operators, by name, and the SQL that gives their rows where SQL can express them."""

from __future__ import annotations

from quern.llm.fingerprints import op2_fingerprints
from quern.llm.linededup import OP6_SQL, op6_line_dedup
from quern.llm.mixing import op8_source_mixing
from quern.llm.neardup import op4_minhash_neardup
from quern.llm.packing import op1_best_fit_packing
from quern.llm.secretscan import op9_secret_scan
from quern.llm.tokentable import op7_token_output
from quern.llm.topk import OP3_SQL, op3_exact_topk
from quern.llm.toxicity import op10_toxicity
from quern.llm.warc import OP5_SQL, op5_warc_reader

QUERIES = {
    "op3_exact_topk": op3_exact_topk,
    "op9_secret_scan": op9_secret_scan,
    "op2_fingerprints": op2_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op5_warc_reader": op5_warc_reader,
    "op8_source_mixing": op8_source_mixing,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op7_token_output": op7_token_output,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": OP3_SQL,
    "op5_warc_reader": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
}
