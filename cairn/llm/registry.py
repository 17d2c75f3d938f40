"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cairn.llm import decontam, secrets
from cairn.llm.ann import op9_ann
from cairn.llm.kd_shard import op10_kd_shard
from cairn.llm.licenses import op7_licenses
from cairn.llm.packing import op3_packing
from cairn.llm.pseudo_lm import op5_pseudo_lm
from cairn.llm.quality import op4_quality
from cairn.llm.simhash import op2_simhash
from cairn.llm.suffix_dedup import op8_suffix_dedup

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_pseudo_lm": op5_pseudo_lm,
    "op6_decontam": decontam.op6_decontam,
    "op7_licenses": op7_licenses,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ann": op9_ann,
    "op10_kd_shard": op10_kd_shard,
}

ORACLES: dict[str, str] = {
    "op1_secrets": secrets.ORACLE,
    "op6_decontam": decontam.ORACLE,
}
