"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lodestar.llm.decontaminate import OP8_SQL, op8_decontamination
from lodestar.llm.media import op7_ogg
from lodestar.llm.packing import op2_packing
from lodestar.llm.perplexity import op6_perplexity
from lodestar.llm.quality import op10_quality
from lodestar.llm.simhash import op1_simhash
from lodestar.llm.substrings import OP4_SQL, op4_substrings
from lodestar.llm.tokencount import op9_token_counts
from lodestar.llm.toxicity import op3_toxicity
from lodestar.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_warc": op5_warc,
    "op6_perplexity": op6_perplexity,
    "op7_ogg": op7_ogg,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substrings": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op8_decontamination": OP8_SQL,
}
