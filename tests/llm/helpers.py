"""Small tables with every odd case, for the corpus operators' tests."""

import random

ODD = [None, "", " \n\t ", "a", "AÉ b", "x" * 300, "a b\x0bc\x0cd e\x1cf", "▁ ▁▁", "\x00 z", "\n\n\n", "Ab\nAb\nAb\nab"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def random_docs(n=120, seed=3, lines=30, vocabulary=12):
    """Rows with few words, so that much repeats, plus the odd cases, a very long text and repeated rows."""
    pick = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        body = [" ".join(pick.choices(names, k=pick.randint(1, 6))) for _ in range(pick.randint(1, lines))]
        rows.append((i, "\n".join(body), pick.choice(["en", "de", None]), pick.choice(["s0", "s0", "s1", None]), 0))
    for i in range(0, 20, 3):
        rows.append((n + i, rows[i][1] + pick.choice(["", " tail"]), "en", "s0", 0))
    rows += [(2 * n + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows += [rows[0], rows[0], (None, "w1 w2 w3", None, None, None), (None, None, None, None, None)]
    rows.append((3 * n, " ".join(pick.choices(names, k=20_000)), "en", "s1", 0))
    return rows


def docs_frame(spark, rows):
    """The rows as ``documents`` with extra columns named like the operators' own."""
    extra = "chunk string, id string, size string, key string, kept string, score string, lang_pred string, removed_lines string"
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"{COLUMNS}, {extra}")


def same_rows(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
