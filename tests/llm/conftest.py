import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rng.randint(2, 8)))
        for _ in range(n)
    )


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, shared passages, nulls, empty and long ones, ties and repeated rows."""
    shared, base = words(1, 80), words(2, 300)
    near = base.split()
    near[150] = "changed"
    texts = [
        None, "", "", " \n\t", "one", "two words", base, base, " ".join(near),
        f"{words(3, 40)} {shared} {words(4, 40)}", f"{words(5, 60)}\n{shared}\n{words(6, 10)}", shared, "ab " * 400,
        words(7, 5000), base + " ", "Ünïcode  tëxt\x1fwith\x0bodd spaces", "x" * 900,
    ]
    texts += [words(100 + i, 60) for i in range(20)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, shared), (None, None), (18, words(50, 70)), (None, shared), (None, words(51, 230))]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # Columns that operators use inside must not clash.
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 9 else None, 1, "x", 2) for i, t in corpus]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n long, key string, size long",
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
