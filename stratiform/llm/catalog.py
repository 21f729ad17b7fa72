"""The subpackage's queries and their SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op3_bpe
from .decontaminate import OP8_SQL, op8_decontaminate
from .extract import op6_extract
from .langid import op10_langid
from .ledger import ABLATIONS_SQL, OP1_SQL, op1_ledger, quality_ablations
from .ngram_join import OP7_SQL, op7_ngram_join
from .repair import op2_repair
from .secrets import op9_secrets
from .toxicity import op4_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_ledger": op1_ledger,
    "op2_repair": op2_repair,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_extract": op6_extract,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_langid": op10_langid,
    "quality_ablations": quality_ablations,
}
SQL = {"op1_ledger": OP1_SQL, "quality_ablations": ABLATIONS_SQL, "op5_warc": OP5_SQL, "op7_ngram_join": OP7_SQL, "op8_decontaminate": OP8_SQL}
