"""The queries of this folder, and the SQL that some of them are held against."""

from __future__ import annotations

from geolode.llm import contamination, language, lattice, licenses, matroska, nbest, oracles, sharding, simhash, substrings, suffixes


def queries() -> dict:
    return {
        "op1_lattice_lm": lattice.op1_lattice_lm,
        "op2_hierarchical_language": language.op2_hierarchical_language,
        "op3_differencing_shards": sharding.op3_differencing_shards,
        "op4_fm_substrings": substrings.op4_fm_substrings,
        "op5_simhash": simhash.op5_simhash,
        "op6_suffix_arrays": suffixes.op6_suffix_arrays,
        "op7_diagonal_licenses": licenses.op7_diagonal_licenses,
        "op8_nbest_sentencepiece": nbest.op8_nbest_sentencepiece,
        "op9_pigeonhole_leaks": contamination.op9_pigeonhole_leaks,
        "op10_matroska": matroska.op10_matroska,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
