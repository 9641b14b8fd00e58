"""Expressions over alignment fields."""

from pyspark.sql import Column, functions as F


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR spans (operations M, D, N, = and X)."""
    # One-operation CIGARs, nearly all of them, need no array.
    simple = F.regexp_extract(cigar, r"^(\d+)[M=X]$", 1)
    counts = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    total = F.aggregate(
        counts, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long")
    )
    return F.when(simple != "", simple.try_cast("long")).otherwise(total)


def depth_class(depth: Column) -> Column:
    """Name of the half-open depth class that holds ``depth``."""
    label = F.lit(DEPTH_CLASSES[-1][0])
    for name, _, upper in reversed(DEPTH_CLASSES[:-1]):
        label = F.when(depth < upper, F.lit(name)).otherwise(label)
    return label


# Depth classes [lower, upper) (fixed values).
DEPTH_CLASSES = (
    ("no_coverage", 0, 1),
    ("low_coverage", 1, 10),
    ("medium_coverage", 10, 50),
    ("high_coverage", 50, 100),
    ("very_high_coverage", 100, None),
)
