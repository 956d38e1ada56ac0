"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from fairlead.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from fairlead.llm.lexical_search import OP12_SQL, op12_lexical_search
from fairlead.llm.line_dedup import OP3_SQL, op3_line_dedup
from fairlead.llm.lm_scoring import op8_lm_scoring
from fairlead.llm.mixing import op1_mixing
from fairlead.llm.neighbours import op5_neighbours
from fairlead.llm.packing import op4_packing
from fairlead.llm.periodic_runs import op11_periodic_runs
from fairlead.llm.shingle_join import op10_shingle_join
from fairlead.llm.tokens import op2_token_counts
from fairlead.llm.toxicity import op9_toxicity
from fairlead.llm.transcripts import op7_transcripts
from fairlead.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_neighbours": op5_neighbours,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_transcripts": op7_transcripts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_shingle_join": op10_shingle_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}

SQL = {
    "op3_line_dedup": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_warc": OP13_SQL,
}
