"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from refloom.llm.decontaminate import op8_decontaminate
from refloom.llm.html import op9_html
from refloom.llm.linededup import op6_linededup
from refloom.llm.middle import OP13_SQL, op13_middle
from refloom.llm.mixing import op1_mix
from refloom.llm.quality import op10_quality
from refloom.llm.resample import op3_resample
from refloom.llm.sharding import op12_shards
from refloom.llm.simhash import op2_simhash
from refloom.llm.targets import OP11_SQL, op11_targets
from refloom.llm.tokens import op4_tokens
from refloom.llm.toxicity import op7_toxicity
from refloom.llm.warc import op5_warc

QUERIES = {
    "op1_mix": op1_mix,
    "op2_simhash": op2_simhash,
    "op3_resample": op3_resample,
    "op4_tokens": op4_tokens,
    "op5_warc": op5_warc,
    "op6_linededup": op6_linededup,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
    "op11_targets": op11_targets,
    "op12_shards": op12_shards,
    "op13_middle": op13_middle,
}

ORACLE_SQL: dict[str, str] = {"op11_targets": OP11_SQL, "op13_middle": OP13_SQL}
