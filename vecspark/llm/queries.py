"""The queries that apply each operator to its whole table, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from vecspark.llm.bpe import op8_bpe
from vecspark.llm.chat import OP3_SQL, op3_chat
from vecspark.llm.decontamination import OP5_SQL, op5_decontamination
from vecspark.llm.licenses import op4_licenses
from vecspark.llm.media import op9_media
from vecspark.llm.secrets import op10_secrets
from vecspark.llm.sharding import OP7_SQL, op7_rendezvous
from vecspark.llm.simhash import op2_simhash
from vecspark.llm.suffixes import op1_suffixes
from vecspark.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_rendezvous": op7_rendezvous,
    "op8_bpe": op8_bpe,
    "op9_media": op9_media,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_rendezvous": OP7_SQL}
