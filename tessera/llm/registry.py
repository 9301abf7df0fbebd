"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, html_text, kneser_ney, language_id, licences, line_dedup, minhash, warc


def queries():
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_license_scan": licences.op2_license_scan,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_kneser_ney_quality": kneser_ney.op6_kneser_ney_quality,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_warc": warc.op9_warc,
        "op10_minhash_dedup": minhash.op10_minhash_dedup,
    }


def oracle_sql():
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op7_decontamination": decontaminate.ORACLE, "op9_warc": warc.ORACLE, "op10_minhash_dedup": minhash.ORACLE}
