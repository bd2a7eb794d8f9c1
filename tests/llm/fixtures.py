"""Small awkward tables."""

import random

LONG = " ".join(f"w{i}" for i in range(130))


def documents(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(60, 300)) for _ in range(20)]
    passage = prose(70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]  # exact copies
    rows += [(200 + i, base[i].replace(" ", "  ").replace("a", "a", 1) + "\n") for i in range(3)]  # copies but for white space
    for i in range(8):  # near copies
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, prose(30) + " " + passage + "\n" + prose(20)) for i in range(6)]  # a shared passage
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "one"), (505, "four words are few"), (506, LONG * 40)]
    rows += [(507, "tab\tand\x0bothers \x85　 wide <|endoftext|> ééÀß 12345 don't\n\n  x  ")]
    rows += [(None, "no id"), (None, base[0]), (3, base[3]), (3, base[3])]  # no ids, repeated rows
    return rows


def frame(spark, rows=None, extra=True):
    """documents with further columns whose names are used within the operators."""
    rows = documents() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(d, t, "en", "s", None if t is None else len(t), 1, 2, "x", 3) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, uid long, node long, block string, digest long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
