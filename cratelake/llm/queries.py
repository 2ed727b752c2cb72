"""The registered queries of this subpackage."""

from __future__ import annotations

from cratelake.llm import collocations, debruijn, fixity, language, mixing, packing, quality_model, quality_rules, sampling, simhash, suffixes, urls, whitening

QUERIES = {
    "op1_fingerprints": sampling.op1_fingerprints,
    "op2_mixing": mixing.op2_mixing,
    "op3_suffix_repeats": suffixes.op3_suffix_repeats,
    "op4_debruijn": debruijn.op4_debruijn,
    "op5_packing": packing.op5_packing,
    "op6_language": language.op6_language,
    "op7_simhash": simhash.op7_simhash,
    "op8_rules": quality_rules.op8_rules,
    "op9_quality": quality_model.op9_quality,
    "op10_fixity": fixity.op10_fixity,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_urls": urls.op13_urls,
}

ORACLE_SQL = {"op10_fixity": fixity.OP10_SQL}
