"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, language, minhash, mixing, packing, periodic, quality, substrings, token_files, url_rules, warc, whitening

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality": quality.op2_quality,
    "op3_minhash": minhash.op3_minhash,
    "op4_warc": warc.op4_warc,
    "op5_substrings": substrings.op5_substrings,
    "op6_packing": packing.op6_packing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": language.op8_language,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_token_files": token_files.op10_token_files,
    "op11_whitening": whitening.op11_whitening,
    "op12_mixing": mixing.op12_mixing,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_substrings": substrings.OP5_SQL,
    "op9_url_rules": url_rules.OP9_SQL,
    "op12_mixing": mixing.OP12_SQL,
}
