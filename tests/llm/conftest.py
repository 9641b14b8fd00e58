import random

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, bits long, score string,"
    " row_hash long, nth int, copies int, contaminated string, lang_pred int, part string,"
    " check string, runs int, class int, run int, size int, target string, label_id string,"
    " held_out int, chosen_id int, ids string, crc int"
)
SYLLABLES = {
    "en": ("the ", "th", "ing ", "er", "an", "of ", "tion "),
    "fr": ("le ", "é", "eau ", "ch", "ou", "è", "que "),
}


def prose(rng, lang, words):
    text = "".join(rng.choice(SYLLABLES[lang]) for _ in range(3 * words))
    return " ".join(text.split()[:words])


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice(("en", "fr")), rng.choice((3, 30, 80))) for _ in range(40)]
    rows = [(i, text, "en" if i % 2 else "fr", f"s{i % 3}") for i, text in enumerate(texts)]
    long = prose(rng, "en", 30_000)
    rows += [
        (100, None, "en", "s0"),
        (101, "", "en", None),
        (102, " \n\t", None, "s1"),
        (103, "### 12 $$", "en", "s1"),
        (104, long, "en", "s2"),
        (105, long + " more words here", "en", "s2"),
        (106, texts[3].upper(), "en", None),
        (107, texts[4] + "  " + texts[5], None, "s0"),
        (None, texts[6], "en", "s0"),
        (None, texts[6], "en", "s0"),
        (None, None, None, None),
        (5, texts[5], "en", "s2"),
        (5, texts[5], "en", "s2"),
        (5, texts[7], "en", "s2"),
        (-7, texts[8], "en", "s2"),
        (108, "日本語 é\u00a0ü <|endoftext|> x" * 3, "en", "s1"),
        (109, "a" * 3000, "fr", "s1"),
        (110, "ab " * 1000, "fr", "s1"),
    ]
    for text in texts[:6]:  # near copies
        words = text.split()
        words[len(words) // 2] = "changed"
        rows.append((200 + len(rows), " ".join(words), "en", "s0"))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = (None,) * (len(COLUMNS.split(",")) - 4)
    return spark.createDataFrame([(*row, *extra) for row in odd_rows], COLUMNS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
