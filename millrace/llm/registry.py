"""The queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from millrace.llm import ann, bpe, html_text, langid, merkle, minhash, packing, secrets, tokencount, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_near_duplicates": minhash.op3_near_duplicates,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_html_text": html_text.op6_html_text,
    "op7_language_id": langid.op7_language_id,
    "op8_nearest": ann.op8_nearest,
    "op9_fingerprints": merkle.op9_fingerprints,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op3_near_duplicates": minhash.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
}
