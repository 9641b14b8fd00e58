"""Language identification with n-gram filters that hold one bit for each language.

A slot of the filter is a word with a bit for every language. The slots that an n-gram hashes
to, combined by AND, are all languages that contain it. Counting each language's bits over a
text, less those expected from false positives alone, decides.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.bytetext import encoded, mixed, pieces
from strandline.llm.frames import unused

#: Documents of each language that the filter is made from, about.
SAMPLED = 3000
#: N-grams of each language in the filter, at most.
GRAMS = 20_000
UNDETERMINED = "und"

_SIZE = 4
_HASHES = 2
_SPARSE = 16  # slots for each n-gram, at least
_SHARE = 0.5  # of the share in the language that has an n-gram most
_SEEN = 3  # times in the sample, at least

_BYTES = np.arange(256)
_ASCII = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES < 0x80)
_LOWER = np.where(_ASCII, _BYTES | 0x20, np.where(_BYTES < 0x80, 0x20, _BYTES)).astype(np.uint8)
_LATIN = 0xC3  # before the second byte of the letters from U+00C0 to U+00FF


def _grams(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of four bytes with two or more of letters, as numbers, and each text's count.

    Letters count as lower case, other ASCII characters as spaces.
    """
    if len(data) < _SIZE:
        return np.zeros(0, np.uint32), np.zeros(len(places) - 1, np.int64)
    data = _LOWER[data]
    upper = np.flatnonzero((data[:-1] == _LATIN) & (data[1:] <= 0x9E) & (data[1:] >= 0x80)) + 1
    data[upper] += 0x20
    letters = (data != 0x20).astype(np.uint8)
    ends = len(data) - _SIZE + 1
    enough = sum(letters[i : ends + i] for i in range(_SIZE)) >= 2
    for back in range(1, _SIZE):  # none reaches into the next text
        enough[np.maximum(places[1:] - back, 0).clip(max=ends - 1)] &= places[1:] - back >= ends
    value = np.zeros(ends, np.uint32)
    for i in range(_SIZE):
        value |= data[i : ends + i].astype(np.uint32) << np.uint32(8 * i)
    at = np.flatnonzero(enough)
    return value[at], np.diff(np.searchsorted(at, places))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, for each piece."""
    for batch in pieces(batches):
        langs = batch.column("lang").dictionary_encode()
        found, counts = _grams(*encoded(batch.column("text")))
        owner = np.repeat(langs.indices.to_numpy().astype(np.uint64), counts)
        both, n = np.unique(owner << np.uint64(32) | found, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64))),
                pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                pa.array(n),
            ],
            names=["lang", "gram", "n"],
        )


@dataclass
class Filter:
    """``langs`` in code point order, and ``slots``, one row of words for every 64 of them."""

    langs: list[str]
    usual: int
    slots: np.ndarray

    @classmethod
    def of(cls, members: list[tuple[str, int]], usual: str | None) -> "Filter":
        langs = sorted({lang for lang, _ in members} | ({usual} if usual else set()))
        size = 1 << max(10, (_SPARSE * len({gram for _, gram in members})).bit_length())
        slots = np.zeros((max(1, -(-len(langs) // 64)), size), np.uint64)
        for number, lang in enumerate(langs):
            grams = np.array([gram for own, gram in members if own == lang], np.uint32)
            for at in cls._places(grams, size):
                slots[number // 64, at] |= np.uint64(1) << np.uint64(number % 64)
        return cls(langs, langs.index(usual) if usual else 0, slots)

    @staticmethod
    def _places(grams: np.ndarray, size: int) -> list[np.ndarray]:
        spread = mixed(grams.astype(np.uint64) + np.uint64(1))
        return [(spread >> np.uint64(32 * i)) & np.uint64(size - 1) for i in range(_HASHES)]

    def _wrong(self, number: int) -> float:
        """Chance that an n-gram which a language doesn't contain is found in it all the same."""
        bit = np.uint64(1) << np.uint64(number % 64)
        return float(((self.slots[number // 64] & bit) != 0).mean()) ** _HASHES

    def counts(self, grams: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """For each text and language, the n-grams contained, less those found by chance."""
        places = self._places(grams, self.slots.shape[1])
        stops = np.concatenate(([0], np.cumsum(per_text)))
        out = np.zeros((len(per_text), len(self.langs)))
        for row, slots in enumerate(self.slots):
            mask = slots[places[0]]
            for at in places[1:]:
                mask &= slots[at]
            for number in range(64 * row, min(64 * row + 64, len(self.langs))):
                bits = (mask >> np.uint64(number % 64)).astype(np.uint8) & 1
                found = np.diff(np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))[stops])
                wrong = self._wrong(number)
                out[:, number] = np.maximum(found - wrong * per_text, 0) / (1 - wrong)
        return out

    def best(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language and the share of its counts among all languages' counts."""
        data, places = encoded(column)
        lettered = self._lettered(data, places)
        if not self.langs:
            return [UNDETERMINED] * len(column), np.zeros(len(column))
        counts = self.counts(*_grams(data, places))
        total = counts.sum(1)
        first = np.where(total > 0, counts.argmax(1), self.usual)
        score = np.where(lettered & (total > 0), counts.max(1) / np.where(total > 0, total, 1), 0.0)
        return [self.langs[i] if has else UNDETERMINED for i, has in zip(first, lettered)], score

    @staticmethod
    def _lettered(data: np.ndarray, places: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(_ASCII[data])))
        out = sums[places[1:]] > sums[places[:-1]]
        high = np.concatenate(([0], np.cumsum(data >= 0x80)))
        for i in np.flatnonzero(~out & (high[places[1:]] > high[places[:-1]])).tolist():
            text = data[places[i] : places[i + 1]].tobytes().decode()
            out[i] = any(character.isalpha() for character in text)
        return out


def learned(rows: DataFrame, sampled: int = SAMPLED, grams: int = GRAMS) -> Filter:
    """The filter for the languages of ``rows`` (``text``, ``lang``; rows without either are passed over).

    It is made from a sample of about ``sampled`` rows of each language, taken by a hash of the
    text: n-grams that are there a few times and whose share is at least half of that in the
    language that has them most, ``grams`` of a language at most, the most frequent. The rows of
    all languages are counted. A language has at most 256**4 n-grams, and the driver gets
    ``grams`` numbers for each.
    """
    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "lang").first()
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = (
        rows.join(sizes, "lang")
        .filter(draw * F.col("rows") < sampled)
        .select("text", "lang")
    )
    counted = (
        drawn.mapInArrow(_counted, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
        .filter(F.col("n") >= _SEEN)
        .withColumn("most", F.max("share").over(Window.partitionBy("gram")))
        .filter(F.col("share") >= _SHARE * F.col("most"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    chosen = counted.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= grams)
    members = [(row.lang, row.gram) for row in chosen.select("lang", "gram").collect()]
    return Filter.of(members, usual.lang if usual else None)


def _guesser(model: Filter, names: tuple[str, str]) -> Callable:
    def guess(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lang, score = model.best(batch.column("text"))
            yield batch.append_column(names[0], pa.array(lang, pa.string())).append_column(
                names[1], pa.array(score)
            )

    return guess


def guessed(docs: DataFrame, model: Filter, names: tuple[str, str]) -> DataFrame:
    """``docs`` with two more columns: the language of each whole text, and its score, 0 to 1.

    The language is one of the model's, or ``und`` where the text is null or has no letter, or
    where nothing was learned. Of languages with equal counts the first in code point order is
    taken; where no n-gram is known, the one with most learned rows, with the score 0.
    """
    schema = docs.select(
        "*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])
    ).schema
    for name in names:
        schema[name].nullable = True
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _guesser(broadcast.value, names)(batches)

    return docs.mapInArrow(run, schema)


def held_out_third(doc_id: str = "doc_id"):
    """Whether nothing is learned from a row: the CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, sampled: int = SAMPLED, grams: int = GRAMS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for each row of ``docs``.

    Learned only from ``text`` and ``lang`` of rows that are not held out and have an id; the
    guess uses the text only. See ``guessed`` for nulls and ties. Repeated rows are each judged;
    other columns are not read; an empty table gives an empty one.
    """
    model = learned(docs.filter(F.col("doc_id").isNotNull() & ~held_out_third()), sampled, grams)
    rows = docs.select("doc_id", held_out_third().alias("held_out"), "text")
    return guessed(rows, model, ("lang_pred", "score")).drop("text")


def in_known_languages(docs: DataFrame, sampled: int = SAMPLED, grams: int = GRAMS) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages learned from ``docs``; columns as given.

    Rejected are only texts that ``guessed`` gives no language: those that are null or have no
    letter, and all where nothing was learned. A text too short for a known n-gram stays.
    """
    model = learned(docs.filter(F.col("doc_id").isNotNull() & ~held_out_third()), sampled, grams)
    names = unused(docs, "lang_pred"), unused(docs, "score")
    return guessed(docs, model, names).filter(F.col(names[0]) != UNDETERMINED).drop(*names)
