import pickle
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from gridquarry.llm import grace, simhash
from gridquarry.llm.components import components


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Union-find over all pairs."""
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return find


def test_fingerprints_and_components(frame, corpus):
    got = simhash.near_duplicates(frame(corpus)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in corpus]
    find = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    want = Counter((i, f"{f:016x}", least.get(find(f))) for i, f in prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    stays = [r["component_id"] for r in got if r["stays"]]
    assert len(stays) == len({find(f) for _, f in prints})


def test_every_anchor_of_every_close_pair_is_shared():
    flips = simhash._near_anchors()

    def anchors(half):
        s = 0
        for p in range(31):
            s ^= (p + 1) * (half >> p & 1)
        return [half ^ f for f in flips[s]]

    rng = np.random.default_rng(1)
    for x in map(int, rng.integers(0, 1 << 32, 200)):
        home = anchors(x)[0]
        assert (home ^ x).bit_count() <= 1
        for b in range(32):
            assert home in anchors(x ^ 1 << b)
        assert home in anchors(x)


def test_links_find_all_pairs_of_random_balls(spark):
    rng, fps = np.random.default_rng(5), set()
    for centre in map(int, rng.integers(0, 1 << 64, 20, dtype=np.uint64)):
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(100, 59)], [(9, 3), (3, 9), (7, 8), (8, 2), (2, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    assert got == {n: min(reach(n)) for n in near}


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        norm = (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
        groups[norm].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for norm, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out[m[3], members[0][3], len(members), k == 0, sha256(norm.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("table_bytes", [grace.TABLE_BYTES, 700])
def test_exact_duplicates(frame, corpus, table_bytes):
    got = grace.exact_duplicates(frame(corpus), table_bytes=table_bytes).drop("__row").collect()
    assert Counter(tuple(r) for r in got) == plain_exact(corpus)


def test_without_repeated_ids(frame, corpus):
    rows = list({r[0]: r for r in corpus if r[0] is not None}.values())
    assert Counter(tuple(r) for r in grace.exact_duplicates(frame(rows)).drop("__row").collect()) == plain_exact(rows)


def test_empty_tables(frame):
    assert grace.exact_duplicates(frame([])).count() == 0
    assert simhash.near_duplicates(frame([])).count() == 0


@given(st.lists(st.tuples(st.binary(max_size=3), st.integers(0, 5), st.integers(0, 3)), max_size=200), st.integers(300, 3000))
@settings(max_examples=60, deadline=None)
def test_fold_spills_and_agrees(items, most):
    records = [(c, (p, i, 1, 1)) for c, p, i in items]
    want = {}
    for c, v in records:
        want[c] = grace.folded(want[c], v) if c in want else v
    got = list(grace.fold(iter(records), most))
    assert dict(got) == want and len(got) == len(want)


def test_fold_bears_equal_hashes(monkeypatch):
    monkeypatch.setattr(grace.Table, "hash", lambda self, content: content[0] >> self.level & 1)  # two chains, and one in the end
    records = [(bytes([k % 50, 0]), (1, k, 1, 1)) for k in range(300)]
    assert dict(grace.fold(iter(records), 1 << 30)) == {bytes([k, 0]): (1, k, 1, 6) for k in range(50)}


def test_spill_files_are_gone(tmp_path, monkeypatch):
    monkeypatch.setattr(grace.tempfile, "tempdir", str(tmp_path))
    assert len(list(grace.fold(((pickle.dumps(k), (1, k, 1, 1)) for k in range(500)), 2000))) == 500
    assert not list(tmp_path.iterdir())
