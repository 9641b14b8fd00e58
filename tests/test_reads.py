import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import reads as R

READ = "sample_id string, read_id string, mate byte, seq string, qual string"
PAIR = "sample_id string, read_id string, seq1 string, qual1 string, seq2 string, qual2 string"
PARTNER = str.maketrans("ACGTN", "TGCAN")


def flip(text):
    return text.translate(PARTNER)[::-1]


def reads(spark, *pairs):
    return spark.createDataFrame(
        [("s", f"r{i}", 1, seq, qual) for i, (seq, qual) in enumerate(pairs)], READ
    )


def test_verdicts(spark):
    frame = reads(
        spark,
        ("A" * 50, "I" * 50),
        ("A" * 50, "I" * 30 + "#" * 20),
        ("A" * 50, "I" * 29 + "#" * 21),
        ("N" * 5 + "A" * 45, "I" * 50),
        ("N" * 6 + "A" * 44, "I" * 50),
        ("A" * 14, "I" * 14),
        ("", ""),
    )
    found = [r.verdict for r in R.label_reads(frame).orderBy("read_id").collect()]
    assert found == [
        "passed",
        "passed",
        "low_quality",
        "passed",
        "too_many_n",
        "too_short",
        "too_short",
    ]
    assert R.quality_filter(frame).count() == 5
    assert R.length_filter(frame, 50).count() == 5
    assert R.mean_quality_filter(frame, 20).count() == 6
    reasons = {r.verdict: r.reads for r in R.filter_reasons(frame).collect()}
    assert reasons == {"passed": 3, "low_quality": 1, "too_many_n": 1, "too_short": 2}


def test_tail_trim(spark):
    frame = reads(
        spark,
        ("ACGTACGTAC", "IIIIII####"),
        ("ACGTACGTAC", "IIIIIIIIII"),
        ("ACGTACGTAC", "##########"),
        ("ACG", "###"),
        ("", ""),
        ("ACGTACGTAC", "5555544444"),
    )
    found = [
        (r.seq, r.qual) for r in R.tail_trim(frame).orderBy("read_id").collect()
    ]

    def trimmed(seq, qual):
        scores = [ord(c) - 33 for c in qual]
        for i in range(len(scores) - 3):
            if sum(scores[i : i + 4]) < 80:
                return seq[:i], qual[:i]
        return seq, qual

    given = [(r.seq, r.qual) for r in frame.orderBy("read_id").collect()]
    assert found == [trimmed(*pair) for pair in given]
    nothing = frame.limit(1).withColumn("qual", F.lit(None).cast("string"))
    assert R.tail_trim(nothing).select("seq", "qual").first() == ("ACGTACGTAC", None)


def brute_overlap(a, b):
    for s in [*range(0, len(a)), *range(-1, -len(b), -1)]:
        low, high = max(0, s), min(len(a), s + len(b))
        n = high - low
        if n < 30:
            continue
        differ = sum(a[i] != b[i - s] for i in range(low, high))
        if differ <= 5 and differ * 100 <= n * 20:
            return s
    return None


def test_overlap_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        insert = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 180)))
        adapter = "".join(rng.choice("ACGT") for _ in range(200))
        one = (insert + adapter)[: rng.choice([60, 75])]
        two = (flip(insert) + adapter[::-1])[: rng.choice([60, 75])]
        one = "".join(rng.choice("ACGT") if rng.random() < 0.03 else c for c in one)
        rows.append(("s", str(i), one, "I" * len(one), two, "I" * len(two)))
    rows.append(("s", "empty", "", "", "", ""))
    frame = spark.createDataFrame(rows, PAIR)
    found = {r.read_id: r for r in R.find_overlap(frame).collect()}
    kinds = set()
    for _, key, one, _, two, _ in rows:
        start = brute_overlap(one, flip(two))
        assert found[key].overlap_start == start
        if start is None:
            assert found[key].insert_length is None and found[key].overlap_length is None
        else:
            assert found[key].insert_length == start + len(two)
        kinds.add(None if start is None else (start > 0) - (start < 0))
    assert kinds == {None, -1, 0, 1} or kinds == {None, -1, 1}


def test_adapter_removal(spark):
    rng = random.Random(9)

    def text(n):
        return "".join(rng.choice("ACGT") for _ in range(n))

    through, whole, apart = text(40), text(60), text(200)
    rows = [
        ("s", "through", through + text(20), "I" * 60, flip(through) + text(20), "J" * 60),
        ("s", "whole", whole, "I" * 60, flip(whole), "J" * 60),
        ("s", "apart", apart[:60], "I" * 60, flip(apart)[:60], "J" * 60),
    ]
    found = {r.read_id: r for r in R.pair_overlap_trim(spark.createDataFrame(rows, PAIR)).collect()}
    assert found["through"].seq1 == through and found["through"].seq2 == flip(through)
    assert found["through"].qual1 == "I" * 40 and found["through"].qual2 == "J" * 40
    assert found["whole"].insert_length == 60 and found["whole"].seq1 == whole
    assert found["apart"].insert_length is None and found["apart"].seq1 == apart[:60]


def test_mates(spark):
    frame = spark.createDataFrame(
        [
            ("s", "a", 1, "AC", "II", None, 0),
            ("s", "a", 2, "GG", "JJ", None, 0),
            ("s", "b", 1, "TT", "II", None, 7),
            ("t", "a", 2, "CC", "II", None, 9),
            ("t", None, 1, None, None, "malformed record", 9),
        ],
        READ + ", error string, ordinal long",
    )
    pairs = R.mate_join(frame)
    assert [tuple(r) for r in pairs.collect()] == [("s", "a", "AC", "II", "GG", "JJ")]
    assert {(r.read_id, r.mate, r.seq) for r in R.split_pairs(pairs).collect()} == {
        ("a", 1, "AC"),
        ("a", 2, "GG"),
    }
    mate = F.col("mate")
    checked = R.join_mates_checked(frame.filter(mate == 1), frame.filter(mate == 2))
    again = R.split_pairs(checked.filter("error is null")).orderBy("ordinal").collect()
    assert [(r.read_id, r.mate, r.ordinal) for r in again] == [("a", 1, 0), ("a", 2, 1)]
    errors = {(r.sample_id, r.read_id): r.error for r in checked.collect()}
    assert errors == {
        ("s", "a"): None,
        ("s", "b"): "read without mate: b",
        ("t", "a"): "read without mate: a",
        ("t", None): "malformed record",
    }


def test_quality_report(spark):
    frame = reads(spark, ("ACGT", "!5?I"), ("GG", "II"))
    row = R.read_qc(frame).first()
    assert (row.reads, row.bases, row.q20_bases, row.q30_bases, row.gc_bases) == (2, 6, 5, 4, 4)
    assert row.mean_length == 3.0 and row.q20_rate == pytest.approx(5 / 6)
    cycles = {r.cycle: r for r in R.cycle_profile(frame).collect()}
    assert set(cycles) == {1, 2, 3, 4}
    assert (cycles[1].bases, cycles[1].a_bases, cycles[1].g_bases) == (2, 1, 1)
    assert cycles[1].mean_quality == 20.0 and cycles[4].t_bases == 1


def test_duplication(spark):
    rows = [("s", str(i), "AC", "II", "GG", "II") for i in range(3)]
    rows += [("s", "x", "GG", "II", "AC", "II"), ("t", "y", "AC", "II", "GG", "II")]
    frame = spark.createDataFrame(rows, PAIR)
    levels = {(r.sample_id, r.copies): r.distinct_pairs for r in R.duplication_levels(frame).collect()}
    assert levels == {("s", 3): 1, ("s", 1): 1, ("t", 1): 1}
    rate = {r.sample_id: r.duplication_rate for r in R.duplication_rate(frame).collect()}
    assert rate == {"s": 0.5, "t": 0.0}


def test_pairs_by_record(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 100)
    schema = (
        "sample_id string, read_id string, mate byte, seq string, qual string, ordinal long,"
        " error string"
    )
    names = ["a.1", "x", "x", "x", "b 1", "c"]
    rows = []
    for i, name in enumerate(names):
        rows.append(("s", name, 1, f"A{i}", "I", 60 * i, None))
        other = {"a.1": "a.2", "b 1": "b 2", "c": "d"}.get(name, name)
        rows.append(("s", other, 2, f"C{i}", "I", 70 * i, None))
    rows.append(("t", "x", 1, "A", "I", 0, None))
    rows.append(("s", None, 2, None, None, 900, "broken"))
    frame = spark.createDataFrame(rows, schema)
    pairs = R.pair_by_record(frame.filter("mate = 1"), frame.filter("mate = 2"))
    found = sorted(pairs.collect(), key=lambda r: (r.sample_id, r.ordinal))
    assert [(r.read_id, r.seq1, r.seq2) for r in found[:6]] == [
        (name, f"A{i}", f"C{i}") for i, name in enumerate(names)
    ]
    assert [r.names_differ for r in found[:6]] == [False] * 5 + [True]
    assert [r.error for r in found] == [None] * 6 + ["broken", "read without mate: x"]


def test_cycle_profile_of_uneven_reads(spark):
    rows = [("s", "r1", 1, "ACé", "I5"), ("s", "r2", 1, "A", "55#"), ("s", "r3", 2, "", "")]
    rows += [("s", "r4", 1, None, "II"), ("s", "r5", 1, "AC", None), (None, "r6", None, "N", "")]
    frame = spark.createDataFrame(rows, "sample_id string, read_id string, mate byte, seq string, qual string")
    found = {(r.sample_id, r.cycle): r for r in R.cycle_profile(frame).collect()}
    assert sorted(found, key=str) == [("s", 1), ("s", 2), ("s", 3), (None, 1)]
    first, second, third = (found["s", i] for i in (1, 2, 3))
    assert (first.bases, first.a_bases, first.quality_sum) == (2, 2, 60)
    assert (second.bases, second.c_bases, second.quality_sum) == (2, 1, 40)
    assert (third.bases, third.a_bases, third.quality_sum, third.mean_quality) == (2, 0, 2, 1.0)
    none = found[None, 1]
    assert (none.bases, none.n_bases, none.quality_sum, none.mean_quality) == (1, 1, None, None)
    assert R.cycle_profile(frame.limit(0)).count() == 0


def test_filter_on_the_overlap_stays_above_the_search(spark):
    """A filter on what the search finds is no second search over rows that hold whole texts."""
    whole = spark.createDataFrame([("s", "ACGTTGCAAC" * 40)], "sample_id string, whole string")
    pairs = whole.selectExpr(
        "sample_id",
        "substr(whole, 1, 60) as seq1",
        "reverse(translate(substr(whole, 21, 60), 'ACGT', 'TGCA')) as seq2",
    )
    sizes = R.insert_sizes(R.find_overlap(pairs))
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    below = plan[plan.index("ArrowEvalPython") :].splitlines()[1]
    assert "AS seq1" in below and "AS seq2" in below
    assert [tuple(row) for row in sizes.collect()] == [("s", 60, 1)]
