import random

import pytest

SCHEMA = "doc_id long, text string, row string, h string, label string, n_chars long"


def make_documents() -> list[tuple]:
    """Texts with copies, shared lines, secrets, licenses, junk, nulls, blanks, a long text, ties and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = "This line of more than forty characters stands in many documents."
    texts: list[str | None] = [None, "", "   ", "one", "two words", "the same three words here", "x" * 5000, prose(9000)]
    base = prose(150).split()
    for k in range(12):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 3
    texts += [prose(30) + "\n" + ("  " + shared.upper() + "\t" if k % 2 else shared) + "\n" + prose(8) for k in range(7)]
    texts += [prose(30) + "\nOnly four documents share this line, which is long enough." for _ in range(4)]
    texts += [
        'é token = "abcdef12" password:short api_key=ABCDEF1234 TOKEN=xyz', "AKIA" + "Q7" * 9 + " AKIA123 " + "0f" * 20 + "g",
        "secret=secret=secret1 token=token:abcdefgh", "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----",
        prose(20) + " Released under the MIT License. " + prose(5), "Licensed under the Apache License, Version 2.0.",
        "Licensed under CC BY-NC 4.0.", "This fine work is licensed under the terms of the GNU General Public License, version 3",
        " ".join(["again"] * 60), " | ".join(prose(60).split()), "### " + " ".join(w + "$$$" for w in prose(60).split()), prose(60).upper() + "!!",
        "don't  stop\n\n  we'll <|endoftext|> go　on\xa0now \r\n é́ 12345", "A\tb\x0bc\x0cd\re\x1cf g",
    ]
    rows = [(k, t, f"r{k}", None, "x", 1) for k, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (9, "another text of document nine", None, None, None, None), (None, prose(25), None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
