"""The queries of this package, and their SQL where SQL can state them."""

from __future__ import annotations

from . import chat, class_lm, embedding_links, html_text, passages, periodic_runs, pieces, pu_quality, secrets, simhash, target_resampling, token_counts, winnowing

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_html_text": html_text.op2_html_text,
    "op3_pu_quality": pu_quality.op3_pu_quality,
    "op4_cover_tree": embedding_links.op4_cover_tree,
    "op5_pieces": pieces.op5_pieces,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op8_winnowing": winnowing.op8_winnowing,
    "op7_class_lm": class_lm.op7_class_lm,
    "op10_chat": chat.op10_chat,
    "op9_simhash": simhash.op9_simhash,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_target_resampling": target_resampling.op13_target_resampling,
}

ORACLES: dict[str, str] = {
    "op4_cover_tree": embedding_links.ORACLE,
    "op8_winnowing": winnowing.ORACLE,
    "op13_target_resampling": target_resampling.ORACLE,
}
