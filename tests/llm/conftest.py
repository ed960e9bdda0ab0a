import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest_words import prose  # noqa: E402


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def texts(rng):
    """Ordinary texts, copies, near copies, shared passages and odd texts, by id."""
    out = {i: prose(rng, rng.randint(1, 250)) for i in range(40)}
    passage = prose(rng, 120)
    for i in range(40, 50):
        out[i] = prose(rng, rng.randint(5, 60)) + " " + passage + " " + prose(rng, rng.randint(5, 60))
    base = prose(rng, 200).split(" ")
    for i in range(50, 62):
        near = list(base)
        for _ in range(i - 50):
            near[rng.randrange(len(near))] = f"edit{rng.randint(0, 99)}"
        out[i] = " ".join(near)
    out |= {70: out[3], 71: out[3], 72: None, 73: "", 74: " \n\t ", 75: "a" * 1500, 76: "é" * 700, 77: "é" * 700, 78: "x", 79: "日本語 テスト 😀 ok　wide", 80: "<|endoftext|> in a text", 81: "line one two\nline one two\nline one two", 82: prose(rng, 6000), 83: "1 2 3 4 5 1 2 3 4 5", 84: "ISN'T it's İstanbul ΑΣ ½ Ⅷ", 85: "á á \x1c \x85 x", 86: "see [1] and [2] # end | <b> $5 & 3% *"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns of clashing names."""
    rows = [(i, t, "en", "src", 0 if t is None else len(t), 1, "z") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, score string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
