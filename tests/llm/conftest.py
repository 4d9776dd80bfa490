import random

import pytest

WORDS = "thon erre ouch able ing hest wald baum haus für über señor niño été forêt 3 42 A.b x-y".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, with ids from 0."""

    def build(texts, langs=None):
        rows = [(i, t, langs[i] if langs else "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return build


@pytest.fixture(scope="session")
def messy():
    """Texts with copies, near copies, shared passages, a long one, blanks and a null."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
    passage, texts = prose(60), [prose(rng.randint(1, 80)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " extra", prose(20) + " " + passage + " " + prose(9), passage, prose(7) + "\n" + passage, prose(4000)]
    texts += ["", "   \t\n", None, "Uno.", "　 ", "a b c d e f g h i j k l m n " * 3, "ABC abc " * 40]
    return texts


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
