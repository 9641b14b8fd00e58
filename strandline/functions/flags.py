"""Predicates over the alignment flag column."""

from pyspark.sql import Column, functions as F

# Flag bits of the SAM format (fixed values).
PAIRED = 1
PROPER_PAIR = 2
UNMAPPED = 4
MATE_UNMAPPED = 8
REVERSE = 16
MATE_REVERSE = 32
FIRST_OF_PAIR = 64
SECOND_OF_PAIR = 128
SECONDARY = 256
QC_FAIL = 512
DUPLICATE = 1024
SUPPLEMENTARY = 2048


def flag_matches(flag: Column, set_bits: int, clear_bits: int = 0) -> Column:
    """True where all ``set_bits`` are on and all ``clear_bits`` are off."""
    return flag.bitwiseAND(F.lit(set_bits | clear_bits)) == set_bits


def is_mapped(flag: Column) -> Column:
    return flag_matches(flag, 0, UNMAPPED)


def is_qc_failed(flag: Column) -> Column:
    return flag_matches(flag, QC_FAIL)


def is_paired_primary(flag: Column) -> Column:
    return flag_matches(flag, PAIRED, SECONDARY | SUPPLEMENTARY)


def is_properly_paired(flag: Column) -> Column:
    return flag_matches(
        flag, PAIRED | PROPER_PAIR, UNMAPPED | SECONDARY | SUPPLEMENTARY
    )


def is_both_mapped(flag: Column) -> Column:
    return flag_matches(
        flag, PAIRED, UNMAPPED | MATE_UNMAPPED | SECONDARY | SUPPLEMENTARY
    )


def is_singleton(flag: Column) -> Column:
    return flag_matches(
        flag, PAIRED | MATE_UNMAPPED, UNMAPPED | SECONDARY | SUPPLEMENTARY
    )
