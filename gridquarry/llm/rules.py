"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0). The votes of all documents
are counted by pattern: at most 3 ** 9 counts, however many documents there are.
Expectation-maximisation over these counts estimates the share of good documents
and, for each rule, how often it votes good on either kind; a document stays when
the posterior probability that it is good reaches one half.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ROW, SPACE, cut, map_rows, numbered, utf8

SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
MARKS = b"!?"
RUNS = re.compile(b"[" + re.escape(SYMBOLS) + b"]+").findall
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_marked")


def _without(b: bytes, some: bytes) -> int:
    return len(b) - len(b.translate(None, some))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, their first occurrence included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # else the product below would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(np.diff(keys[order]) == 0)
    starts = np.union1d(order[same], order[same + 1])
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``; null is empty."""
    b = utf8(text)
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.translate(None, SPACE)]
    return (
        len(words), len(text or "") - _without(b, SPACE), _without(b, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), _without(b, UPPER), _without(b, LETTERS), _without(b, MARKS), len(RUNS(b)),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote from the counts."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))

    def between(value: Column, bad_from: float, good_to: float) -> Column:
        return F.when(value >= bad_from, -1).when(value <= good_to, 1).otherwise(0)

    length = c["word_chars"] / words
    return {
        "length": F.when(c["n_words"] < 10, -1).when(c["n_words"] >= 50, 1).otherwise(0),
        "word_length": F.when((length < 2) | (length > 14), -1).when((length >= 3) & (length <= 10), 1).otherwise(0),
        "symbols": between(c["n_symbols"] / words, 0.2, 0.05),
        "marked": between(c["n_marked"] / words, 0.2, 0.05),
        "lines": between(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)), 0.3, 0.1),
        "repeats": between(c["n_repeat_words"] / words, 0.2, 0.1),
        "capitals": F.when(c["n_letters"] == 0, 0).otherwise(between(c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0)), 0.5, 0.2)),
        "marks": between(c["n_marks"] / words, 0.3, 0.1),
        "letters": F.when(c["n_letters"] == 0, 0).otherwise(-between(c["n_letters"] / F.greatest(c["word_chars"], F.lit(1.0)), 0.9, 0.8)),
    }


#: Shares of good votes expected of good and of bad documents, and their weight beside the documents'.
EXPECTED, STRENGTH = (0.98, 0.6), 0.2


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(prior log-odds of good, log-likelihood ratio of each rule's bad and good vote).

    patterns: votes, one row each; counts: documents with them. It starts from
    "no rule objects"; each rate is drawn a little to what is expected of a rule.
    """
    good = np.where((patterns < 0).any(1), 0.05, 0.95)
    plus, minus = patterns > 0, patterns < 0
    for _ in range(rounds):
        rate, prior = [], (counts @ good + 1) / (counts.sum() + 2)
        for p, share in zip((good, 1 - good), EXPECTED, strict=True):
            w = counts * p
            weight = STRENGTH * w.sum() + 1
            rate.append((w @ plus + share * weight) / (w @ (plus | minus) + weight))
        ratio = np.log(np.stack([(1 - rate[0]) / (1 - rate[1]), rate[0] / rate[1]]))
        ratio = np.stack([np.minimum(ratio[0], 0), np.maximum(ratio[1], 0)])  # a good vote never speaks against a document
        odds = np.log(prior / (1 - prior)) + minus @ ratio[0] + plus @ ratio[1]
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(np.log(prior / (1 - prior))), ratio


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: its row number, id, the counts, base_failed, the posterior and kept.

    Null texts count as empty: all counts 0, base_failed true. Ids may be null or
    repeat; each row stands for itself. An empty table gives no rows; other
    columns are not read, so their names may clash. Texts of any length are counted
    whole. A posterior of exactly one half keeps the row. A single bad vote is
    outvoted unless its rule objects to hardly any good document.
    """
    docs = numbered(docs, F.col(id).alias("id"), F.col(text).alias("text")).select(ROW, "id", "text")
    kind = f"{ROW} long, id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = cut(map_rows(docs, kind, lambda c: [c[0], c[1], *(map(list, zip(*map(measure, c[2]), strict=True)) if c[2] else [[]] * len(COUNTS))]))
    rules = votes()
    seen = rows.groupBy(*(v.alias(k) for k, v in rules.items())).count().collect()  # 3 ** 9 rows at most
    if seen:
        prior, ratio = fit(np.array([r[:-1] for r in seen]), np.array([r[-1] for r in seen], float))
        odds = sum((F.when(v < 0, F.lit(float(ratio[0, k]))).when(v > 0, F.lit(float(ratio[1, k]))).otherwise(0.0) for k, v in enumerate(rules.values())), F.lit(prior))
    else:
        odds = F.lit(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = 1 / (1 + F.exp(-odds))
    return rows.select(ROW, F.col("id").alias(id), *COUNTS[:5], failed.alias("base_failed"), (~failed & (good >= 0.5)).alias("kept"), good.alias("posterior"))
