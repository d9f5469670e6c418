import base64
import itertools
import math
from hashlib import md5, sha256

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gridquarry.llm import mixing, rules, simhash
from gridquarry.llm._shared import numbered, pinned
from gridquarry.llm.queries import MULTI_RANKS, ORACLE_SQL, PATTERN, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_runs_over_its_whole_table(spark, sf_dir, name):
    table = {"op8": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf_dir).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_bears_odd_rows(spark, frame, corpus, sf_dir):
    """All stages on null, empty, long and repeated texts, with columns that clash; then on an empty table."""
    docs = frame(corpus).withColumns({"__row": F.lit("own"), "__copies": F.lit("own"), "__docs": F.lit(1), "a.b c": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if stage is not corpus_pipeline.tokens:
            assert out.columns == docs.columns
            whole = {tuple(r) for r in docs.collect()}
            assert all(tuple(r) in whole for r in rows)
            if stage is not corpus_pipeline.quality_rules:  # which keeps little of this corpus
                docs = spark.createDataFrame(rows, docs.schema)
    assert len(rows) > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_rows_keep_their_numbers(spark, sf_dir, tmp_path):
    """However many cores there are when a table is read."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5).write.parquet(str(tmp_path / "docs"))
    read = lambda: {r[0]: r[1] for r in numbered(pinned(spark.read.parquet(str(tmp_path / "docs"))), "doc_id").collect()}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        want = read()
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        assert read() == want
        spark.conf.unset("spark.sql.files.minPartitionNum")
        assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() > len({k >> 33 for k in want})  # else they would be split anew
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_rules(docs):
    """Expectation-maximisation document by document."""
    counts = {i: dict(zip(rules.COUNTS, rules.measure(t), strict=True)) for i, (t, _) in docs.items()}

    def vote(value, bad, good):
        return -1 if value >= bad else 1 if value <= good else 0

    votes = {}
    for i, c in counts.items():
        n, letters = max(c["n_words"], 1), c["n_letters"]
        length = c["word_chars"] / n
        votes[i] = [
            -1 if c["n_words"] < 10 else 1 if c["n_words"] >= 50 else 0, -1 if length < 2 or length > 14 else 1 if 3 <= length <= 10 else 0,
            vote(c["n_symbols"] / n, 0.2, 0.05), vote(c["n_marked"] / n, 0.2, 0.05), vote(c["n_dup_lines"] / max(c["n_lines"], 1), 0.3, 0.1), vote(c["n_repeat_words"] / n, 0.2, 0.1),
            vote(c["n_upper"] / letters, 0.5, 0.2) if letters else 0, vote(c["n_marks"] / n, 0.3, 0.1), 0 if not letters else -vote(letters / max(c["word_chars"], 1), 0.9, 0.8),
        ]
    good = {i: 0.05 if -1 in v else 0.95 for i, v in votes.items()}
    for _ in range(500):
        prior, rate = (sum(good.values()) + 1) / (len(good) + 2), {}
        for kind, expected in ((1, 0.98), (0, 0.6)):
            weight = {i: g if kind else 1 - g for i, g in good.items()}
            strength = 0.2 * sum(weight.values()) + 1
            for j in range(9):
                plus, all_ = (sum(w for i, w in weight.items() if votes[i][j] in which) for which in ((1,), (1, -1)))
                rate[kind, j] = (plus + expected * strength) / (all_ + strength)
        new = {}
        for i, v in votes.items():
            odds = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                odds += min(0, math.log((1 - rate[1, j]) / (1 - rate[0, j]))) if x < 0 else max(0, math.log(rate[1, j] / rate[0, j])) if x > 0 else 0
            new[i] = 1 / (1 + math.exp(-odds))
        done = max(abs(new[i] - good[i]) for i in new) < 1e-9
        good = new
        if done:
            break
    kept = [i for i, c in counts.items() if good[i] >= 0.5 and c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"]]
    return {i: docs[i] for i in kept}


def plain_pipeline(rows):
    """The five stages without Spark, over ids that are unique: every pair of fingerprints is compared."""
    docs = plain_rules({i: (t, s) for i, t, s in rows})
    best = {}
    for i, (t, _) in docs.items():
        norm = t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
        best[norm] = min(best.get(norm, (0, i)), (-len(t), i))
    docs = {i: docs[i] for _, i in best.values()}
    prints = {i: simhash.fingerprint(t) for i, (t, _) in docs.items()}
    group = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(docs, 2):
            if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    docs = {i: d for i, d in docs.items() if group[i] == i}
    size = {i: len(t.encode().split()) for i, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()})
    total = [sum(size[i] for i, (_, x) in docs.items() if x == s) for s in sources]
    out = []
    for s, whole, goal in zip(sources, total, mixing.targets(total, [(5, 2, 1)[k % 3] for k in range(len(sources))]), strict=True):
        offset, each = int(md5(f"0:{s}".encode()).hexdigest()[:13], 16) / 2**52, goal / whole
        for k, i in enumerate(sorted((i for i in docs if docs[i][1] == s), key=lambda i: (size[i], i))):
            out += [i] * (math.floor((k + 1) * each + offset) - math.floor(k * each + offset))
    with open(MULTI_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = {i: encoding.encode_ordinary(docs[i][0]) for i in set(out)}
    return sorted((i, len(tokens[i]), sha256(np.array(tokens[i], "<u4").tobytes()).hexdigest(), sha256(docs[i][0].encode()).hexdigest()) for i in out)


def test_pipeline_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == plain_pipeline(rows)
