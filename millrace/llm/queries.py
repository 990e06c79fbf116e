"""The registered queries of the text operators and the SQL that they must agree with."""

from . import bpe, chat_format, decontamination, html_extract, licence_scan, line_dedup, lm_score, quality, simhash_dedup, token_files

QUERIES = {
    "op1_simhash": simhash_dedup.op1,
    "op2_token_files": token_files.op2,
    "op3_bpe": bpe.op3,
    "op4_quality": quality.op4,
    "op5_lm_score": lm_score.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_html_extract": html_extract.op7,
    "op8_chat_format": chat_format.op8,
    "op9_licence_scan": licence_scan.op9,
    "op10_decontamination": decontamination.op10,
}

ORACLES: dict[str, str] = {
    "op4_quality": quality.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_licence_scan": licence_scan.ORACLE,
}
