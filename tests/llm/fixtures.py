"""Invented texts, and documents that hold every case an operator must define."""

import random

CLASHING = "lang string, source string, n_chars long, row string, score double, spans string, class long, n long, " \
           "sequence_id long, anchor long, key string, range int, kept string"


def invented(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "le", "mi", "tor", "né", "sa"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage = invented(1, 120), invented(2, 60)
    words = base.split(" ")
    near = words[:]
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "ONE"),
            (9, invented(3, 80) + " " + passage), (10, passage + " " + invented(4, 80)),
            (11, "x" * 3000), (12, invented(5, 3) * 40), (13, invented(6, 6000)), (14, "😀🙂 漢字 " * 30),
            (15, base.upper()), (20, "ties\n" * 60), (21, "ties\n" * 60), (None, base), (None, None),
            (30, invented(7, 40)), (30, invented(7, 40)), (31, invented(8, 40)), (31, invented(9, 40))]
    rows += [(40 + i, " ".join(words[:i] + [f"w{i}"] + words[i + 1:])) for i in range(12)]
    return rows
