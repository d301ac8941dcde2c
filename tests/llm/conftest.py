import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog. It was late, and nobody saw it run away.\nSecond line here.\nThird line there.",
    "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    "", " \n\t ", None, "one", "one two three", "a b c d", "A  b\tC d", "naïve café ▁ mark 中文字 😀 <s> &amp;",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank, short, long, equal and repeated rows, and extra columns with likely names."""
    long = " ".join(f"w{i % 997} x{i}." for i in range(30_000))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, TEXTS[0]), (50, TEXTS[0]), (None, TEXTS[0]), (None, None), (60, long), (61, long + " end")]
    extra = "shard, slot, kept, sha, chars, key, words, spans, unit, comp, region, ids, decoded, row, first, n_words, text_key, rank, labels, size".split(", ")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{e} string" for e in extra)
    return spark.createDataFrame([(i, t, None if i is None or i % 3 == 0 else "en", None if i == 5 else "s", None, *(["?"] * len(extra))) for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
