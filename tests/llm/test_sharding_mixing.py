import random
import zlib
from collections import Counter, defaultdict

import pytest

from gridquarry.llm import binpack, mixing


def plain_pack(sizes, capacity, bins=None):
    rooms = [capacity] * (bins or 0)
    out = Counter()
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits)[1]
        elif bins is None:
            rooms.append(capacity)
            k = len(rooms) - 1
        else:
            k = max((r, k) for k, r in enumerate(rooms))[1]
        rooms[k] -= s
        out[s, k] += 1
    return out


@pytest.mark.parametrize("bins", [None, 5])
def test_packing_equal_sizes_at_once_is_best_fit_decreasing(bins):
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 7, rng.randint(1, 50)]) for _ in range(rng.randint(0, 60))]
        got = Counter()
        for s, first, last, k in binpack.pack(list(Counter(sizes).items()), 60, bins):
            got[s, k] += last - first + 1
        assert got == plain_pack(sizes, 60, bins)


def test_level_leaves_out_what_overfills():
    assert binpack.level([(100, 1), (1, 30)], 4) == 10
    assert binpack.level([(5, 4)], 4) == 5
    assert binpack.level([], 4) == 0
    assert binpack.level([(7, 1)], 1) == 7


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def test_shards(frame, corpus):
    got = binpack.sharded(frame(corpus), shards=4).collect()
    check_shards(corpus, got, 4)
    where, load = defaultdict(set), Counter()
    text_of = defaultdict(set)
    for i, t, *_ in corpus:
        text_of[i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())].add(t)
    for r in got:
        load[r["shard"]] += r["size"]
        for t in text_of[r["doc_id"], r["size"], r["text_crc32"]]:
            if t:
                where[t].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    groups = Counter(t for _, t, *_ in corpus)
    whole = [((len((t or "").encode()) + 1) * n, 1) for t, n in groups.items()]
    level = binpack.level(whole, 4)
    assert min(load.values()) > 0.95 * level or max(w for w, _ in whole) > level


def test_shards_with_cells(frame, corpus, monkeypatch):
    monkeypatch.setattr("gridquarry.llm._positions.CELL_ROWS", 16)
    check_shards(corpus, binpack.sharded(frame(corpus), shards=3).collect(), 3)
    got = binpack.sharded(frame(corpus), shards=None, capacity=30_000).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 30_000 and len(load) >= sum(load.values()) / 30_000


def test_rows_of_a_hot_id_are_dealt_to_all_cells(spark, monkeypatch):
    from gridquarry.llm import _positions

    monkeypatch.setattr(_positions, "CELL_ROWS", 16)
    rows = spark.range(300).selectExpr("id AS __row", "CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS id")
    load = Counter(r["cell"] for r in _positions.dealt(rows, "id", "__row", 10).collect())
    assert len(load) == 10 and max(load.values()) < 60


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 10.0]
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]
    assert sum(mixing.targets([1, 2, 3, 1000], [5, 2, 1, 5])) == 1006


@pytest.mark.parametrize("cell_rows", [8192, 16])
def test_mix(frame, corpus, monkeypatch, cell_rows):
    monkeypatch.setattr("gridquarry.llm._positions.CELL_ROWS", cell_rows)
    size = lambda t: len((t or "").encode().split())
    got = mixing.mixed(frame(corpus)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in corpus)
    sources = defaultdict(int)
    for _, t, _, s, _ in corpus:
        sources[s] += size(t)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([sources[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    assert sorted(set((r["source_size"], r["target"]) for r in got)) == sorted({(sources[s], goals[s]) for s in order})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        largest[r["source_size"], r["target"]] = max(largest[r["source_size"], r["target"]], r["size"])
    for k, words in taken.items():
        assert abs(words - k[1]) <= (2 if cell_rows > 100 else 6) * largest[k]
    again = mixing.mixed(frame(corpus)).collect()
    assert Counter(taken.values()) == Counter(_sums(again).values())


def _sums(rows):
    out = Counter()
    for r in rows:
        out[r["source_size"], r["target"]] += r["taken"]
    return out


def test_copies_of_equal_documents_differ_by_one(frame):
    got = mixing.mixed(frame([(k, "one two", None, "a" if k < 10 else "b", 0) for k in range(40)])).collect()
    for s in (20, 60):
        copies = {r["copies"] for r in got if r["source_size"] == s}
        assert max(copies) - min(copies) <= 1
    assert sum(r["taken"] for r in got) in range(76, 85)


def test_empty(frame):
    assert mixing.mixed(frame([])).count() == 0
    assert binpack.sharded(frame([])).count() == 0
