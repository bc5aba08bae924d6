"""The queries of this subpackage, by name."""

from __future__ import annotations

from . import compression, exact_dedup, interpolation, license_scan, maxplus, packing, quality_rules, simhash, substring, warc


def queries() -> dict:
    return {
        "op1_fertility_rules": quality_rules.op1_fertility_rules,
        "op2_compression_classifier": compression.op2_compression_classifier,
        "op3_warc_writer": warc.op3_warc_writer,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_maxplus_pieces": maxplus.op5_maxplus_pieces,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_mixture_packing": packing.op8_mixture_packing,
        "op9_deleted_interpolation": interpolation.op9_deleted_interpolation,
        "op10_substring_dedup": substring.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_writer": warc.OP3_SQL, "op6_license_scan": license_scan.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op10_substring_dedup": substring.OP10_SQL}
