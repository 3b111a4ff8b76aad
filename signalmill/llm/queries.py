"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from signalmill.llm.chat import OP7_SQL, op7_chat_formatting
from signalmill.llm.decontamination import OP12_SQL, op12_decontamination
from signalmill.llm.interaction import OP13_SQL, op13_filter_audit
from signalmill.llm.jaccard import OP9_SQL, op9_jaccard
from signalmill.llm.mixing import op10_mixing
from signalmill.llm.packing import op4_packing
from signalmill.llm.pii import op3_pii
from signalmill.llm.quality import op8_quality_rules
from signalmill.llm.runs import op11_periodic_runs
from signalmill.llm.scoring import op1_lm_scoring
from signalmill.llm.suffix import op6_suffix_dedup
from signalmill.llm.toxicity import op2_toxicity
from signalmill.llm.vectors import OP5_SQL, op5_vectors

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_vectors": op5_vectors,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard": op9_jaccard,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {"op5_vectors": OP5_SQL, "op7_chat_formatting": OP7_SQL, "op9_jaccard": OP9_SQL, "op12_decontamination": OP12_SQL, "op13_filter_audit": OP13_SQL}
