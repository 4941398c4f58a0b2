"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from quire.llm.chat import OP5_SQL, op5_chat_format
from quire.llm.decontaminate import op4_decontaminate
from quire.llm.language_id import op2_language_id
from quire.llm.line_dedup import OP1_SQL, op1_line_dedup
from quire.llm.mixing import op9_mixing
from quire.llm.quality import OP8_SQL, op8_quality_rules
from quire.llm.sharding import op7_sharding
from quire.llm.simhash import op10_simhash
from quire.llm.suffix_dedup import op3_suffix_dedup
from quire.llm.token_output import op6_token_ids


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup, "op2_language_id": op2_language_id, "op3_suffix_dedup": op3_suffix_dedup, "op4_decontaminate": op4_decontaminate, "op5_chat_format": op5_chat_format, "op8_quality_rules": op8_quality_rules, "op6_token_ids": op6_token_ids, "op7_sharding": op7_sharding, "op9_mixing": op9_mixing, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_chat_format": OP5_SQL, "op8_quality_rules": OP8_SQL}
