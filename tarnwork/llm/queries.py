"""Registered queries of the corpus operators; each runs its operator over its whole table."""

from __future__ import annotations

from tarnwork.llm import bitsliced, lines, mixing, neardup, phrases, pii, postings, resample, suffixes, whitening, wumanber
from tarnwork.llm.common import table
from tarnwork.llm.pieces import encode
from tarnwork.llm.quality import grade_documents


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op1_repeated_lines(spark, sf_dir):
    return lines.digest(lines.remove_repeated_lines(table(spark, sf_dir, "documents")))


def op1_repeated_long_lines(spark, sf_dir):
    """Runs of two lines, and single lines of 13 words or more."""
    return lines.digest(lines.remove_repeated_lines(table(spark, sf_dir, "documents"), long_words=lines.LONG))


def op2_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_base_forms(spark, sf_dir):
    """The columns of op2_personal_data that SQL can state."""
    return pii.base_forms(op2_personal_data(spark, sf_dir))


def op4_source_targets(spark, sf_dir):
    """The columns of op4_mix_sources that SQL can state."""
    return mixing.source_targets(op4_mix_sources(spark, sf_dir))


def op3_grade_quality(spark, sf_dir):
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest_vectors(spark, sf_dir):
    return postings.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op6_exact_top(spark, sf_dir):
    return bitsliced.exact_top(table(spark, sf_dir, "embeddings"))


def op7_repeated_phrases(spark, sf_dir):
    return phrases.digest(phrases.remove_phrases(table(spark, sf_dir, "documents")))


def op8_sample_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op10_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_benchmark_passages(spark, sf_dir):
    return wumanber.digest(wumanber.passages_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_importance_draw(spark, sf_dir):
    return resample.importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitened_vectors(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_deviations(spark, sf_dir):
    """The columns of op13_whitened_vectors that SQL can state."""
    return whitening.deviations_only(op13_whitened_vectors(spark, sf_dir))


QUERIES = {
    "op1_repeated_lines": op1_repeated_lines,
    "op1_repeated_long_lines": op1_repeated_long_lines,
    "op2_personal_data": op2_personal_data,
    "op3_grade_quality": op3_grade_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_exact_top": op6_exact_top,
    "op7_repeated_phrases": op7_repeated_phrases,
    "op8_sample_pieces": op8_sample_pieces,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_benchmark_passages": op11_benchmark_passages,
    "op12_importance_draw": op12_importance_draw,
    "op13_whitened_vectors": op13_whitened_vectors,
    "op13_deviations": op13_deviations,
    "op2_base_forms": op2_base_forms,
    "op4_source_targets": op4_source_targets,
}
ORACLE_SQL: dict[str, str] = {
    "op1_repeated_lines": lines.SQL,
    "op1_repeated_long_lines": lines.SQL_LONG,
    "op2_base_forms": pii.SQL,
    "op4_source_targets": mixing.SQL,
    "op5_nearest_vectors": postings.SQL,
    "op6_exact_top": bitsliced.SQL,
    "op7_repeated_phrases": phrases.SQL,
    "op9_suffix_dedup": suffixes.SQL,
    "op10_near_duplicates": neardup.SQL,
    "op11_benchmark_passages": wumanber.SQL,
    "op12_importance_draw": resample.SQL,
    "op13_deviations": whitening.SQL,
}
