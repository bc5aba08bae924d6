"""A small table with everything that can go wrong in a row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, node long, digest string, word string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


PASSAGE = prose(99, 60)


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, prose(2, 200)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"),
        (8, prose(3, 40) + " " + PASSAGE), (9, PASSAGE + "\n" + prose(4, 50)), (10, "again and again " * 40), (11, prose(5, 30_000)),
        (12, "É漢字 😀 ▁ <|endoftext|> tail"), (None, "no id " * 30), (None, None), (13, "x" * 5000), (14, prose(6, 80) + "\nReleased under the MIT License.\n" + prose(7, 20)),
        (15, "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free Software\nFoundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY\nWARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A\nPARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ]
    out = [(i, t, "it" if i is None or i % 3 else None, f"s{(i or 0) % 3}" if i != 7 else None, None if t is None else len(t), "b", 1, "d", "w") for i, t in texts]
    return [*out, out[3], out[3]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
