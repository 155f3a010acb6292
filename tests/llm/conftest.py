from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, range string, start string, node string, hub string, window string, size string, score string, lang_pred string, ambiguous string, s_id string, s_lang string, m_id string, m_copies string, m_copy string, place string, part string, c1 string, d_name string"
WORDS = "the of and river stone light under carry morning window garden paper silver quiet follow answer distant market letter travel".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def table(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * 19) for i, t, lang, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def documents():
    """Null, empty and long texts, equal texts, near copies, a repeated row, null source and id."""
    rng = random.Random(11)
    long = prose(rng, 6000)
    base = prose(rng, 120).split()
    rows = [(0, None, None, None), (1, "", "en", "b"), (2, " \n\t ", "en", "b"), (3, long, "en", "a"), (4, "One", "en", "a"), (5, "one", "de", "a"), (6, "été 😀 ﬁn", "fr", "é")]
    rows += [(10 + k, " ".join(base), "en", "a") for k in range(5)]
    for k in range(25):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(1, 5)):
            w[at] = f"new{rng.randrange(10**6)}"
        rows.append((20 + k, " ".join(w), "en", "a"))
    rows += [(100 + k, prose(rng, rng.randint(1, 300)), "en", rng.choice(["a", "b", "c", "d", None])) for k in range(60)]
    rows += [rows[-1], (None, prose(rng, 20), "en", "b")]
    return rows
