"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from weftgraph.llm import crf, media, mixing, ngram, simhash, sitetree, subword, superkmer, template, viterbi

QUERIES = {
    "op1_subword": subword.op1_subword,
    "op2_ngram": ngram.op2_ngram,
    "op3_sitetree": sitetree.op3_sitetree,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_media": media.op6_media,
    "op7_crf": crf.op7_crf,
    "op8_template": template.op8_template,
    "op9_viterbi": viterbi.op9_viterbi,
    "op10_superkmer": superkmer.op10_superkmer,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op10_superkmer": superkmer.ORACLE}
