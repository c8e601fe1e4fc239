from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "hy") for b in ("lan", "mor", "nes", "tik", "vus", "r")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, edge cases; ids are distinct."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    passage, long = prose(rng, 60), prose(rng, 900)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, rng.randint(0, 30))}" for _ in range(6)]
    texts += [texts[3], texts[3] + " ", texts[3].replace(" ", "\n\t"), texts[3].upper()]
    near = long.split()
    for i in range(5):
        changed = list(near)
        changed[100 + 37 * i] = "changed"
        texts.append(" ".join(changed))
    texts += [f"{passage} {passage} {passage}", "aaaa" * 300, "ab" * 500, "x" * 199, "y" * 200, "y" * 200]
    texts += ["", None, " \t\n ", "one", "one two three", "É à 世界 \U0001f600 " * 70, "\U0001f600 " * 200]
    texts += ["Call +1 (377) 555-0271 or a.b@c.example.org, 10.0.0.255 and 4111 1111 1111 1111."]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return [(None if d == 7 else d, t) for d, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with a source, a language and columns whose names operators use inside."""
    frame = spark.createDataFrame(
        [(d, t, None if i % 11 == 0 else f"s{i % 4}", "xy"[i % 2], "clash", 3, i) for i, (d, t) in enumerate(rows)],
        "doc_id long, text string, source string, lang string, size string, digest int, `_row` int",
    )
    return frame.repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
