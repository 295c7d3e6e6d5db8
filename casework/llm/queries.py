"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .chaining import op6_passages
from .cotrain import op5_quality
from .decontaminate import op2_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .elkan import OP13_SQL, op13_elkan
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .line_dedup import OP8_SQL, op8_line_dedup
from .ngram_join import op10_ngram_join
from .secrets import op3_secrets
from .sentencepiece_bpe import op4_sentencepiece
from .toxicity import op9_toxicity
from .vantage import op12_vantage
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_passages": op6_passages,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_divergence": op11_divergence,
    "op12_vantage": op12_vantage,
    "op13_elkan": op13_elkan,
}
SQL = {
    "op1_warc": OP1_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_divergence": OP11_SQL,
    "op13_elkan": OP13_SQL,
}
