"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lexarium.llm import bpe, fingerprint, licences, neighbours, ngrams, packing, pii, quality, setsketch, simhash, spelling, toxicity, turns


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_simhash": simhash.op3_simhash,
        "op4_pii": pii.op4_pii,
        "op5_packing": packing.op5_packing,
        "op6_ngrams": ngrams.op6_ngrams,
        "op7_licences": licences.op7_licences,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality": quality.op10_quality,
        "op11_trie": turns.op11_trie,
        "op12_setsketch": setsketch.op12_setsketch,
        "op13_spelling": spelling.op13_spelling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {"op11_trie": turns.ORACLE_SQL, "op12_setsketch": setsketch.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
