"""Importance resampling, the conversation trie and the language model against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import ITEM_WORD, LOWER, WORD
from pyspark.sql import functions as F

from strandline.llm import language_model as L
from strandline.llm.conversation_trie import Skeleton, conversation_trie
from strandline.llm.importance import importance, kth_key, resampled


def plain_importance(rows, target, longest, percent, least, buckets=10_000):
    """rows: pairs of id and text. For each row features, weight, score, and the drawn in order."""

    def features(text):
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        runs = [
            " ".join(words[i : i + n])
            for n in range(1, longest + 1)
            for i in range(len(words) - n + 1)
        ]
        return len(words), [zlib.crc32(run.encode()) % buckets for run in runs]

    found = [features(text) for _, text in rows]
    ours = Counter(b for _, own in found for b in own)
    theirs = Counter(b for text in target for b in features(text)[1])
    s, t = sum(ours.values()), sum(theirs.values())
    out = []
    for (doc, _), (words, own) in zip(rows, found):
        weight = sum(
            math.floor(1000 * math.log((theirs[b] + 1) * (s + buckets) / ((ours[b] + 1) * (t + buckets))))
            for b in own
        )
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, words, len(own), weight, weight + noise))
    enough = [row for row in out if row[1] >= least]
    enough.sort(key=lambda row: (-row[4], row[0] is None, row[0] or 0, row[2]))
    drawn = enough[: percent * len(enough) // 100]
    return out, [(row[0], row[4]) for row in drawn]


@pytest.mark.parametrize("longest, pivots", [(1, 2), (3, 16)])
def test_importance(spark, odd, odd_rows, longest, pivots):
    target = [odd_rows[3][1], odd_rows[5][1].upper(), None, ""]
    items = spark.createDataFrame([(text,) for text in target], "text string")
    rows = [(row[0], row[1]) for row in odd_rows]
    want, drawn = plain_importance(rows, target, longest, 30, 20)
    found = importance(odd, items, percent=30, longest=longest, pivots=pivots).collect()
    key = lambda row: tuple((x is None, x) for x in row)
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in ranked] == drawn
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    whole = resampled(odd, items, percent=30, longest=longest)
    assert whole.columns == odd.columns
    assert sorted(r.doc_id for r in whole.collect() if r.doc_id is not None) == sorted(
        doc for doc, _ in drawn if doc is not None
    )


def test_importance_of_equal_rows_and_empty_tables(spark, empty):
    text = "one two three " * 10
    same = spark.createDataFrame([(None, text)] * 300 + [(7, text)] * 100, "doc_id long, text string")
    none = same.filter("false").select("text")
    found = importance(same, none, percent=50, pivots=3)
    assert found.filter("rank is not null").count() == 200
    assert sorted(r[0] for r in found.select("rank").dropna().collect()) == list(range(1, 201))
    assert importance(empty, same).count() == 0
    assert resampled(same, same, percent=0).count() == 0


def test_kth_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice((None, 1, 2, 2, 2)), rng.choice("ab"), i) for i in range(400)]
    keys = spark.createDataFrame(rows, "a int, b string, place long")
    order = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, *row[1:]))
    for k in (1, 2, 133, 399, 400):
        assert tuple(kth_key(keys, k, pivots=3)) == order[k - 1]


def plain_trie(rows, block=5, head=9):
    """rows: conv_id, turn, role, text."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % head
        base = sorted(turns.get(conv - int(math.fmod(conv, block)), []))
        paths[conv] = tuple(t[3:] for t in [*base[:h], *sorted(own)[h:]])
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in sorted(paths.items()):
        ends[path].append(str(conv))
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(own),
            len(node),
            min(members[node[:-1]]) if node else -(10**9),
            len(own),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(ends[node]).encode()).hexdigest(),
        )
        for node, own in members.items()
    )


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(9)
    says = ["", "a", "b", "é ü", "long " * 400, None]
    rows = []
    for conv in range(-12, 60):
        for turn in range(rng.choice((1, 2, 3, 9, 12))):
            rows.append((conv * 5 if conv % 3 else conv, turn, "user", rng.choice(says[:3])))
    rows += [(conv, t, "user", text) for conv in range(1000, 1400, 5) for t, text in enumerate("aab")]
    rows += [(2000, t, None, rng.choice(says)) for t in range(700)]
    rows += [(2005, t, None, row[3]) for t, row in enumerate(rows[-700:])]
    rows += [(3000, None, "user", "x"), (3000, None, "user", "x"), (3000, 1, None, None)]
    rows += [(None, 1, "user", "x"), (4001, 0, "user", "y")]
    return rows


@pytest.mark.parametrize("shard_turns, skeleton", [(200_000, 1 << 20), (10, 1 << 20), (10, 300)])
def test_conversation_trie(spark, chats, shard_turns, skeleton):
    extra = [(*row, 1, "x") for row in chats]
    schema = "conv_id long, turn long, role string, text string, shard int, path string"
    table = spark.createDataFrame(extra, schema)
    found = conversation_trie(table, shard_turns=shard_turns, most_skeleton=skeleton).collect()
    got = sorted(
        tuple(-(10**9) if x is None else x for x in row) for row in map(tuple, found)
    )
    assert got == plain_trie(chats)


def test_trie_of_nothing(spark, chats):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).count() == 0
    # copies the only turns there are, none
    rows = [(i, 0, "user", "x") for i in range(1, 5) if zlib.crc32(str(i).encode()) % 9]
    table = spark.createDataFrame(rows, schema)
    found = [tuple(row) for row in conversation_trie(table).collect()]
    assert len(found) == 1 and found[0][:7] == (rows[0][0], 0, None, len(rows), 0, 1, 0)


def test_skeleton_shares_prefixes():
    a, b, c = (bytes([i]) * 16 for i in range(3))
    skeleton = Skeleton([(a + b, [1, 2]), (a + c, [1, 3]), (b, [2])])
    assert skeleton.parent == [-1, 0, 1, 1, 0] and skeleton.size == [0, 1, 2, 3, 2]


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), " "]


def plain_model(texts, order, least):
    """Scores by the same formula, from dictionaries of quantised counts."""
    single, grams = Counter(), defaultdict(Counter)
    for text in texts:
        own = tokens_of(text)
        single.update(own)
        for size in range(2, order + 1):
            line = [" ", *own]
            for i in range(len(line) - size + 1):
                grams[tuple(line[i : i + size - 1])][line[i + size - 1]] += 1
    n, v = sum(single.values()), len(single)
    rare = [c for w, c in single.items() if c < least and w != " "]
    mean = sum(rare) / max(1, len(rare))
    steps = [least * L.BASE**i for i in range(100)]

    def middle(count):
        q = sum(step <= count for step in steps)
        if not q:
            return 0.0
        low = math.ceil(least * L.BASE ** (q - 1))
        return (low + max(low, math.ceil(least * L.BASE**q) - 1)) / 2

    def whole(history):
        return single[history[0]] if len(history) == 1 else grams[history[:-1]][history[-1]]

    def left(history):
        kept = [c for c in grams[history].values() if c >= least]
        share = max(L._LEAST, 1 - sum(c - L.DISCOUNT for c in kept) / max(1, whole(history)))
        return 1.25 ** -round(-math.log(share) / math.log(1.25))

    def chance(history, word):
        if not history:
            count = middle(single[word]) if single[word] >= least or word == " " else mean
            return ((count or mean) + 0.1) / (n + 0.1 * (v + 1))
        lower = chance(history[1:], word)
        known = middle(whole(history))
        if not known:
            return lower
        seen = middle(grams[history][word])
        return lower * left(history) + max(0, seen - L.DISCOUNT) / max(known, seen) * (seen > 0)

    def score(text):
        own, total = tokens_of(text), 0.0
        for i, word in enumerate(own):
            history = (" ", *own[:i])[-(order - 1) :] if order > 1 else ()
            total += math.log10(min(1.0, chance(tuple(history), word)))
        return total

    return single, n, v, score


@pytest.mark.parametrize("order, frequent", [(3, 1 << 20), (2, 300), (1, 1 << 20), (3, 500)])
def test_language_model(spark, odd, odd_rows, order, frequent, monkeypatch):
    # with so many bits an entry, the filter has no wrong yes
    monkeypatch.setattr(L, "_BITS", 400)

    def out(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0

    training = [row[1] for row in odd_rows if not out(row[0])]
    n = sum(len(tokens_of(text)) for text in training)
    least = max(1, -(-n // frequent))
    single, n, v, score = plain_model(training, order, least)
    found = L.language_model(odd, order=order, frequent=frequent, known=50, sketch=1 << 12).collect()
    assert len(found) == len(odd_rows)
    want = defaultdict(list)
    for doc, text, *_ in odd_rows:
        base = sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens_of(text))
        known = sum(single[w] > 0 for w in tokens_of(text))
        want[doc].append((out(doc), len(tokens_of(text)), known, n, base, score(text)))
    off = []
    for doc, rows in want.items():
        own = [tuple(r)[1:] for r in found if r.doc_id == doc]
        for a, b in zip(sorted(own), sorted(rows)):
            assert a[:4] == b[:4]
            assert a[4] == pytest.approx(b[4], rel=1e-9)
            off.append(abs(a[5] - b[5]) / a[1])
    assert max(off) < 1e-9
    if frequent != 300:
        return
    monkeypatch.undo()  # else a wrong yes moves some tokens by a level
    usual = L.language_model(odd, order=order, frequent=frequent).agg(F.sum("score")).first()[0]
    assert usual == pytest.approx(sum(r.score for r in found), rel=0.02)


def test_language_model_of_nothing(spark, empty):
    assert L.language_model(empty).count() == 0
    held = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id string, text string")
    found = L.language_model(held).orderBy("n_tokens").collect()
    assert [tuple(r) for r in found] == [(None, True, 1, 0, 0, 0.0, 0.0), (None, True, 3, 0, 0, 0.0, 0.0)]


def test_filter_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 20_000, np.uint64)
    levels = rng.integers(1, 9, 20_000)
    filter_ = L.CountFilter(keys, levels)
    got = filter_(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.03
    assert (filter_(rng.integers(0, 1 << 63, 20_000, np.uint64)) > 0).mean() < 0.03


def test_ids_of_any_kind(spark):
    rows = [(f"d{i}", "some words to be weighed and scored " * (i + 1)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = importance(docs, docs.limit(2), percent=20, pivots=2)
    assert found.filter("rank is not null").count() == 5  # of 29 with 20 words
    assert L.language_model(docs).select(F.countDistinct("doc_id")).first()[0] == 30


def test_candidates_are_counted_without_sorting_rows(monkeypatch):
    """Counts by hash are added up in place, and n-grams are counted with their histories."""
    words = [f"w{i}" for i in range(12)]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    known = [np.unique(np.append(L.word_keys(pa.array(words, pa.large_string())), L._END))]
    grams, histories = L._candidates(L._Tokens.of(batch.column("text").cast(pa.large_string())), known)
    counts, before = Counter(grams.tolist()), dict(zip(grams.tolist(), histories.tolist()))
    monkeypatch.setattr(L.np, "unique", None)
    slices = list(L._sketcher(known, 1 << 10)(iter([batch])))
    sums = np.concatenate(
        [
            np.frombuffer(s.column("counts")[0].as_py(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
            for s in slices
        ]
    )
    by_hash = Counter()
    for gram, n in counts.items():
        by_hash[gram % (1 << 10)] += n
    assert {i: n for i, n in enumerate(sums.tolist()) if n} == dict(by_hash)
    (found,) = L._gram_counter(known, np.ones(1 << 10, bool))(iter([batch]))
    rows = {
        key % (1 << 64): (history % (1 << 64), n)
        for key, history, n in zip(*(found.column(c).to_pylist() for c in ("key", "history", "n")))
    }
    assert rows == {gram: (before[gram], n) for gram, n in counts.items()}


@pytest.mark.parametrize("order, hot", [(3, 256), (3, 20), (2, 8), (1, 256), (4, 30)])
def test_whole_language_model(spark, odd, odd_rows, order, hot, monkeypatch):
    """Every n-gram is held, of a corpus in which most are rarer than one in 2^20 of a larger one."""
    monkeypatch.setattr(L, "_BITS", 400)
    monkeypatch.setattr(L, "_PIECE", 5_000)

    def out(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0

    monkeypatch.setattr(L, "HOT", hot)
    training = [row[1] for row in odd_rows if not out(row[0])]
    single, n, v, score = plain_model(training, order, 1)
    found = L.language_model(odd.repartition(3), order=order).collect()
    assert len(found) == len(odd_rows)
    want = defaultdict(list)
    for doc, text, *_ in odd_rows:
        base = sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens_of(text))
        known = sum(single[w] > 0 for w in tokens_of(text))
        want[doc].append((out(doc), len(tokens_of(text)), known, n, base, score(text)))
    for doc, rows in want.items():
        own = [tuple(r)[1:] for r in found if r.doc_id == doc]
        for a, b in zip(sorted(own), sorted(rows)):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_rare_n_grams_of_a_large_corpus_count(spark):
    """Texts that occur twice among very many others are told from texts that occur once."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(0, 300, 3)]
    common = " ".join(["often"] * 12_000)
    rows += [(5000 + i, common) for i in range(300)]  # so that 2 is below one 2^20-th of all tokens
    found = L.language_model(spark.createDataFrame(rows, "doc_id long, text string"))
    twice = {i for i in range(0, 300, 3) if not any(zlib.crc32(str(x).encode()) % 10 == 0 for x in (i, 1000 + i))}
    once = {i for i in range(300) if i % 3 and zlib.crc32(str(i).encode()) % 10}
    score = {r.doc_id: r.score / r.n_tokens for r in found.filter("doc_id < 300").collect()}
    assert min(score[i] for i in twice) > max(score[i] for i in once)
