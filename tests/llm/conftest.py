import random

import pytest

#: Texts with every odd case: null, empty, white space of other kinds, ties, long ones, no letters.
ODD = [None, "", " \t\n\x0b\x0c\r", "\x1c  ", "a", "A  b", "ab", "a b", "É é", "中文 字符", "🙂 ok 🙂", "x" * 20_000, "one two three four five " * 400, "0" * 5000, "\x00", "a\nb\na\nb\n"]


def random_text(rng: random.Random, words: int) -> str:
    bits = ["the", "Ra", "on", "lé", "mi", "ST", "er", "an", "to", "ve", "in", "ß", "12", "x,", "q."]
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, repeated rows and null columns."""
    rng, rows = random.Random(3), []
    base = [random_text(rng, rng.choice([1, 2, 3, 8, 60, 300])) for _ in range(60)]
    for k, text in enumerate(ODD + base + base[:15] + [f" {t} " for t in base[:10]] + [base[3]] * 40):
        rows.append((k * 3 % 1000, text, "en", f"s{k % 7}" if k % 9 else None, None if text is None else len(text)))
    for k, text in enumerate(base[20:40]):
        words = text.split()
        if len(words) > 50:
            words[len(words) // 2] = "changed"
        rows.append((2000 + k, " ".join(words), None, "s0", 0))
    rows += [rows[5], rows[20], rows[20], (None, "no id", None, None, None), (None, "no id", None, None, None), (None, base[3], None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents table, with more columns whose names the operators use inside."""

    def make(rows):
        clashes = ", ".join(f"`{c}` string" for c in ("id", "size", "key", "fp", "hash", "row", "cell", "shard", "sha", "rows", "page", "host", "at", "__n"))
        return spark.createDataFrame([(*r, *["clash"] * 14) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clashes}").repartition(3)

    return make
