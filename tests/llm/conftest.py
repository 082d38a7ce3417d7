import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, raw string, n_words int, key string, host string, keep_id long, keep_hash string, __hash string, __nth int, __failed boolean, __bad string, __score double"


def base_texts(seed=3):
    """Small texts with shared passages, copies, near copies and odd cases."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(30)
    out = [prose(rng.randint(12, 120)) for _ in range(25)]
    out += [out[0], out[0], out[1] + " " + passage, passage + ". " + out[2], prose(10) + passage[3:140] + prose(10), passage[:80] + "é" + passage[80:], passage[:40] + "Ü" + passage[41:]]
    near = prose(200).split()
    for _ in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "changed"
        out.append(" ".join(copy))
    out += ["", None, " ", "one two", "one two", "ä" * 60 + "ö", "xy" * 200, "日本語 テキスト\nab\n\nab\n", "Line a b\nLine a b\n" * 8, "x  y \t z ▁ w <|endoftext|> end ", "All  rights, RESERVED. cc-by cc by; General Public License", "Released under the MlT Licence. \x00 ok", "Releasd under the MIT Licence, as said", passage + " " + out[4]]
    return out


@pytest.fixture(scope="session")
def texts():
    return base_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every case, under column names that clash with inner ones; nulls in any column."""
    rows = [(i if i != 7 else None, t, None, [None, "a.org", "B.org", "b.org"][i % 4], None, "r", None, 5, None, "h", 3, "k", "mine", 4, True, "b", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3], rows[3]], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
