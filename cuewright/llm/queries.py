"""Registry of the subpackage: query functions and their SQL."""

import corpus_pipeline
from cuewright.llm import ann, chat, decontaminate, filter_audit, fim, langid, maxent, packing, pii, secrets, sharding, simhash, suffix

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix": suffix.op2_suffix,
    "op3_ann": ann.op3_ann,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_langid": langid.op6_langid,
    "op7_sharding": sharding.op7_sharding,
    "op8_maxent": maxent.op8_maxent,
    "op9_secrets": secrets.op9_secrets,
    "op10_packing": packing.op10_packing,
    "op11_fim": fim.op11_fim,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_chat": chat.op13_chat,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op11_fim": fim.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_chat": chat.OP13_SQL,
}
