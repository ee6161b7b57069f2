"""The registered queries of the training-data operators and the SQL that answers them."""

from __future__ import annotations

from . import align, bpe, digest, html_text, licenses, media, mixing, ngram_join, packing, quality, repair, urls, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_html_main_text": html_text.op2,
    "op3_license_scan": licenses.op3,
    "op4_media_sniff": media.op4,
    "op5_source_mix": mixing.op5,
    "op6_quality_attention": quality.op6,
    "op7_url_filter": urls.op7,
    "op8_improbable_digest": digest.op8,
    "op9_warc_dictionary": warc.op9,
    "op10_ngram_jaccard": ngram_join.op10,
    "op11_token_alignment": align.op11,
    "op12_structure_repair": repair.op12,
    "op13_bpe_speculation": bpe.op13,
}
SQL = {"op5_source_mix": mixing.OP5_SQL, "op7_url_filter": urls.OP7_SQL, "op9_warc_dictionary": warc.OP9_SQL, "op10_ngram_jaccard": ngram_join.OP10_SQL, "op12_structure_repair": repair.OP12_SQL}
