import pytest

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, long, repeated and unusual texts."""
    import random

    rng = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x260), 0x300, 0x301, 0x3A3, 0x2028, 0x4E00, 0x1F600]]
    fixed = [None, "", "  \n ", "a", "Hello, Wörld! it's 42 <|endoftext|> x", "<|startoftext|><|endoftext|>a<|endoftext|", "İstanbul ΣΑΣ é ＡＢ 日本語 ²½٣", "a\x1cb\x1f c\x85d\xa0e", "same", "same", "x y " * 30_000]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(50)) for _ in range(150)]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """doc_id, text, lang, with clashing extra columns, a null and a repeated identifier."""
    rows = [(i, t, "en" if i % 2 else None, i, "c", 0.5) for i, t in enumerate(odd_texts)]
    rows += [(None, "without an identifier", None, 0, None, None), (8, "same", "en", 1, "z", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, class string, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
