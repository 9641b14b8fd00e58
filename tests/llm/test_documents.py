"""Operators on documents against plain versions, over odd rows and an empty table."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import contamination as plain_contamination
from brute import fingerprint, groups, remaining, statistics
from pyspark.sql import functions as F

from strandline.llm import suffix_dedup
from strandline.llm.components import _dealt, _joined, components
from strandline.llm.decontamination import contamination, without_contamination
from strandline.llm.language import in_known_languages, languages
from strandline.llm.mixing import copies, mixed
from strandline.llm.near_duplicates import links, near_duplicates, without_near_duplicates
from strandline.llm.quality import quality
from strandline.llm.queries import ORACLE
from strandline.llm.suffix_dedup import deduplicated, removal
from strandline.llm.token_files import Encoder, read_token_files, write_token_files
from strandline.llm.toxicity import toxicity
from strandline.plans.storage import scratch_path

tokenizers = pytest.importorskip("public_tokenizers")


def tuples(frame, *columns):
    return Counter(tuple(row) for row in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    texts = [text for _, text, _, _ in odd_rows if text and 20 < len(text) < 2000]
    rows = [
        (1, " ".join(texts[0].split()[:25]).title()),
        (2, " ".join(texts[1].split()[3:15])),
        (10, " ".join(texts[1].split()[3:15])),
        (3, "changed"),
        (4, None),
        (5, " ... "),
        (None, " ".join(texts[9].split()[:12])),
        (2, " ".join(texts[2].split()[:11])),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_contamination(odd, odd_rows, items, block_bytes):
    given = [tuple(row) for row in items.collect()]
    want = Counter()
    for doc, text, _, _ in odd_rows:
        n_words, n_hit, n_items, listed = plain_contamination(text, given)
        want[(doc, n_words, n_hit, n_items, listed, n_hit > 0)] += 1
    found = contamination(odd, items, block_bytes=block_bytes)
    assert tuples(found, *found.columns) == want
    kept = without_contamination(odd, items, block_bytes=block_bytes)
    assert kept.columns == odd.columns
    assert kept.count() == sum(n for row, n in want.items() if not row[-1])


def test_contamination_without_items(odd, items, empty):
    found = contamination(odd, items.limit(0))
    assert found.count() == odd.count() and not found.filter("n_hit > 0").count()
    assert contamination(empty, items).count() == 0
    assert without_contamination(empty, items).count() == 0


@pytest.mark.parametrize("crowded", [1000, 1])
def test_near_duplicates(odd, odd_rows, crowded):
    bits = [fingerprint(text) for _, text, _, _ in odd_rows]
    least = groups(bits)
    smallest = {}
    for group, (doc, *_) in zip(least, odd_rows):
        if doc is not None:
            smallest[group] = min(smallest.get(group, doc), doc)
    want = Counter(
        (doc, f"{own:016x}", smallest.get(group))
        for (doc, *_), own, group in zip(odd_rows, bits, least)
    )
    found = near_duplicates(odd, crowded).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0"), "component_id"
    )
    assert tuples(found, *found.columns) == want
    kept = without_near_duplicates(odd, crowded)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(least))
    ids = {row.doc_id for row in kept.select("doc_id").collect()}
    assert ids == {smallest.get(group) for group in set(least)}


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.int64)
    bits = set(base.tolist())
    for distance in range(1, 7):
        for value in base.tolist():
            flips = rng.choice(63, distance, replace=False)
            bits.add(value ^ int(sum(1 << int(b) for b in flips)))
    bits = sorted(bits)
    prints = spark.createDataFrame([(b,) for b in bits], "bits long")
    want = groups([b & (1 << 64) - 1 for b in bits])
    for crowded in (1000, 1):
        found = links(prints, crowded)
        assert not found.filter("bit_count(a ^ b) > 4 or a = b").count()
        root = {row.node: row.root for row in components(found).collect()}
        assert [bits.index(root.get(b, b)) for b in bits] == want


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0
    assert without_near_duplicates(empty).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (50, 50), (None, 3), (7, 0)]
    pairs += [(100, i) for i in range(101, 160)]
    found = components(spark.createDataFrame(pairs, "x long, y long")).collect()
    root = {row.node: row.root for row in found}
    assert len(found) == len(root)
    assert {root[i] for i in range(21)} == {0}
    assert root[30] == root[40] == 30 and 50 not in root
    assert {root[i] for i in range(100, 160)} == {100}


def test_components_of_a_hub(spark):
    from strandline.llm.components import PARTS, _dealt

    # a hub that isn't the smallest of its component, with most links of all
    pairs = [(5000, i) for i in range(1, 4000)] + [(6000 + i, 7000 + i) for i in range(50)]
    links = spark.createDataFrame(pairs, "u long, v long")
    found = {row.node: row.root for row in components(links).collect()}
    assert {found[i] for i in (*range(1, 4000), 5000)} == {1}
    assert all(found[7000 + i] == found[6000 + i] == 6000 + i for i in range(50))
    dealt, least = _dealt(links)
    sizes = [row["count"] for row in dealt.filter("u = 5000").groupBy("part").count().collect()]
    assert len(sizes) == PARTS and max(sizes) < 2 * 4000 / PARTS
    assert least.filter("u = 5000 and to = 1").count() == 1


def test_mixing(spark, odd, odd_rows, empty):
    found = copies(odd, run=5)
    taken = found.withColumn("taken", F.col("copies") * F.col("size"))
    assert found.count() == len(odd_rows)
    assert not found.filter("copies < 0 or copies > 2").count()
    by_source = taken.groupBy("source").agg(
        F.first("source_size").alias("size"), F.first("target").alias("target")
    )
    rows = {row.source: row for row in by_source.collect()}
    total = sum(row["size"] for row in rows.values())
    assert sum(row.target for row in rows.values()) == pytest.approx(1.5 * total)
    assert all(row.target <= 2 * row["size"] + 1e-6 for row in rows.values())
    free = {3.0: "s0", 1.0: "s1", 2.0: "s2"}
    level = {w: rows[s].target / w for w, s in free.items() if rows[s].target < 2 * rows[s]["size"] - 1e-6}
    assert len({round(x, 6) for x in level.values()}) == 1
    whole = mixed(odd)
    assert whole.columns == odd.columns
    want = copies(odd).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    assert tuples(whole.groupBy("doc_id").count(), "doc_id", "count") == tuples(want, "doc_id", "n")
    assert copies(empty).count() == 0 and mixed(empty).count() == 0


def test_mixing_of_rows_without_an_id(spark):
    rows = [(None, f"word {i} of", "s") for i in range(400)] + [(1, "some more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = copies(docs, run=20).collect()
    taken = sum(row.copies * row.size for row in found if row.source == "s")
    target = next(row.target for row in found if row.source == "s")
    assert len(found) == 401 and abs(taken - target) <= 6
    assert max(row.copies for row in found) <= 2


def test_mixing_against_sql(spark, odd):
    rows = odd.select("doc_id", "text", "source").filter("doc_id <> 5")
    database = duckdb.connect()
    database.register("documents", rows.toArrow())
    want = Counter(
        (a, b, c, round(d, 6), e)
        for a, b, c, d, e in database.execute(
            f"select doc_id, size, source_size, target, taken from ({ORACLE['op5_mixing']})"
            " where doc_id is not null"
        ).fetchall()
    )
    found = copies(rows).select(
        "doc_id", "size", "source_size", F.round("target", 6), F.col("copies") * F.col("size")
    )
    assert tuples(found.filter("doc_id is not null"), *found.columns) == want


def test_quality(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(i, int(i != 3)) for i in range(0, 110)] + [(None, 1), (2, None)],
        "doc_id long, quality int",
    )
    found = quality(odd, labels)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter((doc, *statistics(text)) for doc, text, _, _ in odd_rows)
    assert tuples(found, *names) == want
    failed = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    assert not found.filter(f"base_failed <> ({failed})").count()
    assert not found.filter("base_failed and kept").count()
    assert found.filter("kept").count() >= 20
    assert quality(empty, labels).count() == 0
    assert quality(odd, labels.limit(0)).filter("not base_failed and not kept").count() == 0


def test_quality_of_short_texts_with_symbols(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(rng.integers(25, 300))]
        if i % 20 == 7:  # a few good texts with many capitals or marks
            words = [word.upper() if i % 40 == 7 else word[:2] + "!?!" for word in words]
        if i % 50 == 0:  # short junk
            words = words[:40]
            words[3::6] = ["$" * 5 for _ in words[3::6]]
        rows.append((i, " ".join(words), int(i % 50 > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = {row.doc_id: row.kept for row in quality(docs, docs).collect()}
    assert sum(not found[i] for i, _, good in rows if good) <= 0.002 * 588
    assert sum(not found[i] for i, _, good in rows if not good) >= 11


def test_removal(odd, odd_rows, empty):
    import hashlib

    rows = [(doc, (text or "").encode()) for doc, text, _, _ in odd_rows if doc not in (104, 105)]
    want = Counter(
        (doc, len(text), gone, runs, hashlib.sha256(kept).hexdigest())
        for (doc, text), (gone, runs, kept) in zip(rows, remaining(rows))
    )
    part = odd.filter("doc_id is null or doc_id not in (104, 105)")
    found = removal(part)
    assert tuples(found, *found.columns) == want
    kept = deduplicated(part)
    assert Counter(len(row.kept) for row in kept.collect()) == Counter(
        n - gone for _, n, gone, _, _ in want.elements()
    )
    found = {row.doc_id: row for row in removal(odd.filter("doc_id in (104, 105)")).collect()}
    assert found[104].n_removed == 0 and found[105].n_removed == found[104].n_bytes
    assert removal(empty).count() == 0


def test_removal_of_a_passage_in_most_documents(spark, monkeypatch):
    rng = np.random.default_rng(4)

    def letters(n):
        return "".join(rng.choice(list("abcdefgh"), n))

    passage, line = letters(120), letters(60)
    rows = [(i, letters(90) + passage + letters(70) + line + letters(3)) for i in range(600)]
    rows += [(i, text) for i, text in rows[:40]] + [(600, line), (-1, letters(40) + line[:55])]
    refined, limit = suffix_dedup._refined, 40

    def guarded(table, buckets):
        if table.num_rows > 10 * limit:
            raise MemoryError(table.num_rows)
        return refined(table, buckets)

    monkeypatch.setattr(suffix_dedup, "_refined", guarded)
    monkeypatch.setattr(suffix_dedup, "PART_ASKED", limit)
    found = deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    raw = [(doc, text.encode()) for doc, text in rows]
    want = Counter((doc, kept) for (doc, _), (_, _, kept) in zip(raw, remaining(raw)))
    assert Counter((row.doc_id, bytes(row.kept)) for row in found.collect()) == want


@pytest.mark.parametrize("differing", ["around", "before", "after"])
def test_hashes_that_differ_in_a_few_bits(monkeypatch, differing):
    rng = np.random.default_rng(2)
    one = "".join(rng.choice(list("abcdefgh"), 90))
    block = suffix_dedup._Block(1)
    at, text, gram, around, before, after = suffix_dedup.anchors(
        *suffix_dedup.encoded(pa.array([one, one]))
    )
    names = {"around": around, "before": before, "after": after}
    second = text == 1
    # as if the second text were another one, of nearly the same hash
    names[differing][second] ^= np.uint64(1) << np.uint64(0 if differing == "around" else 40)
    rows = []
    for number in (0, 1):
        own = text == number
        found = (at[own] - 90 * number, text[own] - number, gram[own])
        found += tuple(names[name][own] for name in ("around", "before", "after"))
        monkeypatch.setattr(suffix_dedup, "anchors", lambda *_: found)
        block.add(pa.RecordBatch.from_pydict({"doc_id": [number], "check": [0], "text": [one]}))
        rows += block.emptied()
    compared = suffix_dedup._compared(pa.Table.from_batches(rows), 1)
    assert not any(compared.column("runs").to_pylist())


def test_token_files(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    target = scratch_path(spark, "tokens")
    write_token_files(odd, target, path, shard_ids=20_000, block_ids=5_000)
    assert spark.read.parquet(f"{target}/blocks").select("shard").distinct().count() > 1
    read = read_token_files(spark, target).orderBy("start").collect()
    at = 0
    for row in read:
        assert row.start == at
        at += len(row.ids)
    order = [-1 << 62 if row.doc_id is None else row.doc_id for row in read]
    assert order == sorted(order)
    want = Counter(
        (doc, *library.encode(text or "", add_special_tokens=False).ids, 2)
        for doc, text, _, _ in odd_rows
    )
    assert Counter((row.doc_id, *row.ids) for row in read) == want
    digest = read_token_files(spark, target, digest=True).collect()
    assert Counter((row.doc_id, row.n_tokens, row.ids_crc32) for row in digest) == Counter(
        (key[0], len(key) - 1, zlib.crc32(np.array(key[1:], "<u4").tobytes()))
        for key in want.elements()
    )
    target = scratch_path(spark, "tokens")
    write_token_files(empty, target, path)
    assert read_token_files(spark, target).count() == 0


def test_encoder_over_word_borders():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from strandline.llm.bytetext import encoded

    path = tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    texts = [
        "", " ", "a", "  a  b ", "don't stop,,, it's 'snow, x", "a b 　 c",
        "<|endoftext|> hi<|endoftext|>", "é, è. ÷, ×, ñ ", "a . b , c,d;e:f!g?h", "1,2 3. 4",
        "\n\n x\ty\nz\n", "日本 語, 。 x", "\x00 \x85 x", "naïve — dash", "A ,B", "x  , y",
        "'s, 't\nIt's, we'll. I'd: ", "a\n b\n\nc .", "word\n", "\nword",
    ]
    for _ in range(2):  # the second time all parts are known
        ids, counts = encoder(*encoded(pa.array(texts)))
        stops = np.cumsum(counts)
        for text, a, b in zip(texts, stops - counts, stops):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_language(odd, odd_rows, empty):
    found = languages(odd)
    assert found.count() == len(odd_rows)
    by_id = {row.doc_id: row for row in found.collect()}
    assert {by_id[i].lang_pred for i in (100, 101, 102, 103)} == {"und"}
    assert by_id[109].lang_pred in ("en", "fr") and not found.filter("score < 0 or score > 1").count()
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in by_id if i is not None}
    assert all(by_id[i].held_out == is_held for i, is_held in held.items())
    kept = in_known_languages(odd)
    assert kept.columns == odd.columns
    assert not kept.filter("doc_id in (100, 101, 102, 103)").count()
    assert languages(empty).count() == 0
    unnamed = languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {row.lang_pred for row in unnamed.collect()} == {"und"}


def test_known_languages_keep_short_texts(odd, odd_rows):
    short = odd.withColumn("text", F.when(F.col("doc_id") == 3, "Re.").otherwise(F.col("text")))
    found = languages(short).filter("doc_id = 3").first()
    assert found.lang_pred in ("en", "fr") and found.score == 0
    kept = in_known_languages(short).select("doc_id", "text")
    want = [(row.doc_id, row.lang_pred) for row in languages(short).collect()]
    assert kept.filter("doc_id = 3").count() == 1
    assert tuples(kept, "doc_id") == Counter((doc,) for doc, lang in want if lang != "und")


def test_toxicity(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(0, 110)] + [(None, 1), (2, None), (3, 7)],
        "doc_id long, toxic int",
    )
    rude = F.concat("text", F.lit(" you idiot trash"))
    text = F.when(F.col("doc_id") % 5 == 0, rude).otherwise(F.col("text"))
    marked = odd.withColumn("text", text)
    found = toxicity(marked, labels)
    assert found.count() == len(odd_rows)
    assert not found.filter("score < 0 or score > 1 or score is null").count()
    assert not found.filter("predicted <> cast(score >= 0.3 as int)").count()
    assert {row.score for row in toxicity(odd, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity(empty, labels).count() == 0


def test_what_grows_within_a_task_is_not_broadcast(spark):
    """Replicas and links by part are many more than Spark takes them for."""

    def inner_broadcasts(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        return [line for line in joins if "Inner" in line]

    prints = spark.range(40).select(F.col("id").alias("bits"))  # Spark knows how few these are
    assert inner_broadcasts(links(prints)) == []
    dealt, least = _dealt(spark.range(40).select(F.col("id").alias("u"), (-F.col("id")).alias("v")))
    assert inner_broadcasts(_joined(dealt, least)) == []
