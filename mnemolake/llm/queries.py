"""The queries of this subpackage and their DuckDB SQL. (The entry module registers the pipeline, a script beside the package.)"""

from __future__ import annotations

from . import collocations, decontaminate, language, licenses, near_dups, ngram_join, pieces, spelling, suffix_dedup, token_counts, token_file, toxicity, vectors


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_token_file": token_file.op3_token_file,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_nearest": vectors.op6_nearest,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_near_duplicates": near_dups.op8_near_duplicates,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_language": language.op10_language,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_collocations": collocations.op12_collocations,
        "op13_ngram_join": ngram_join.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op4_token_counts": token_counts.ORACLE, "op5_license_scan": licenses.ORACLE, "op8_near_duplicates": near_dups.ORACLE, "op12_collocations": collocations.ORACLE, "op13_ngram_join": ngram_join.ORACLE}
