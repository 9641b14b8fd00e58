"""Expressions over base and quality strings."""

from pyspark.sql import Column, functions as F

PHRED_OFFSET = 33

# Quality characters in ascending order, '!' (0) to '~' (93) (fixed values).
_QUALITY_CHARS = "".join(chr(PHRED_OFFSET + q) for q in range(94))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def _count_without(text: Column, removed: str) -> Column:
    return F.length(F.translate(text, removed, "")).cast("long")


def gc_count(seq: Column) -> Column:
    return F.length(seq).cast("long") - _count_without(seq, "GCgc")


def n_count(seq: Column) -> Column:
    return F.length(seq).cast("long") - _count_without(seq, "Nn")


def bases_at_least(qual: Column, threshold: int) -> Column:
    """Number of bases whose Phred quality reaches ``threshold``."""
    return _count_without(qual, _QUALITY_CHARS[:threshold])


def bases_below(qual: Column, threshold: int) -> Column:
    return F.length(qual).cast("long") - bases_at_least(qual, threshold)


def characters(text: Column) -> Column:
    """The characters of a string as an array; empty for an empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def phred(qual: Column) -> Column:
    """Quality string to an array of Phred scores."""
    return F.transform(characters(qual), lambda c: F.ascii(c) - PHRED_OFFSET)


def phred_sum(qual: Column) -> Column:
    """Sum of Phred scores, without building the score array."""
    total = F.aggregate(F.split(qual, ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    return (total - PHRED_OFFSET * F.length(qual)).cast("long")


def mean_phred(qual: Column) -> Column:
    return ratio(phred_sum(qual), F.length(qual))


def mismatches(left: Column, right: Column) -> Column:
    """Hamming distance of two strings of equal length."""
    return F.size(
        F.filter(
            F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a != b),
            lambda differs: differs,
        )
    )


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale`` as double; 0 where the denominator is 0."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double") * scale
    ).otherwise(F.lit(0.0))
