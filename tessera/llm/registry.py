"""Queries of this subpackage and the SQL that checks them."""

import corpus_pipeline
from tessera.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from tessera.llm.licenses import OP1_SQL, op1_licenses
from tessera.llm.packing import op3_packing
from tessera.llm.pieces import op5_sentencepiece
from tessera.llm.quality import op4_quality
from tessera.llm.secrets import OP7_SQL, op7_secrets
from tessera.llm.simhash import op10_simhash
from tessera.llm.token_counts import op9_token_counts
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_licenses": op1_licenses,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL = {"op1_licenses": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op7_secrets": OP7_SQL}
