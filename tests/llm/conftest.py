import random

import pytest

WORDS = {
    "en": "the and of to thing water over house green speaks about river".split(),
    "fr": "le la et des eau maison parle vert fleuve être où ça".split(),
}
EXTRA = "start length score kept class word id part rest text_ held_out label lang_pred block"


def text_of(lang: str, words: int, seed: int) -> str:
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS[lang]) + ("." if chosen.random() < 0.1 else "") for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    rows = [(i, text_of("en" if i % 2 else "fr", 60 + i, i), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, " \t\n ", "en"), (103, "one two", None), (104, "12 34 !! 5", "en")]
    rows += [(105, text_of("en", 30_000, 7), "en"), (3, rows[3][1], "en"), (None, text_of("fr", 80, 9), "fr"), (None, rows[5][1], None)]
    rows += [(106, rows[5][1], "en"), (107, rows[5][1] + " end", "en"), (108, "word " * 200, "en"), (109, "  two  spaces▁ here ", "en")]
    names = EXTRA.split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{name}` string" for name in names)
    return spark.createDataFrame([(*row, *["x"] * len(names)) for row in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
