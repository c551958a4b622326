"""Token counts, centroids and importance resampling against the plain way."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lociq.llm import centroids, importance, token_counts
from lociq.llm.queries import op11_token_counts, op12_lloyd_centroids, op13_importance_resampling

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_count(text):
    return len(Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids)


def test_op11_equals_library(spark):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op11_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {}
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        expected[r.doc_id] = (len((r.text or "").encode()), n, n > 512)
    assert got == expected


def test_pieces_do_not_change_counts():
    count, cut = token_counts.load(BYTES)
    assert cut
    rng = random.Random(5)
    bits = ["don't", "'ll", "'s", " ", "  ", "\n", "\n\n ", "\t", "\x85", " ", "\x1c", "abc", "Word", "123", "9a8", "é", "日本語", "、", "。", "<|endoftext|>", "<|", "_", "…", "😀", "a" * 9, "'", "s", "!?"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        whole = count([text])[0]
        for least in (1, 3, 10):
            parts = list(token_counts.pieces(text, least))
            assert "".join(parts) == text and sum(count([p])[0] for p in parts if p) == whole, (text, least)
    texts = ["", "one", "a" * 5000, "word " * 900, "日本語、" * 300]
    for size in (1, 50, 10**9):
        assert token_counts.lengths(iter(texts), len(texts), count, cut, size, 40).tolist() == [plain_count(t) for t in texts]


def test_op11_edges(spark, edge_docs, no_docs):
    out = token_counts.count_tokens(edge_docs, BYTES, limit=5)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = Counter((r.doc_id, len((r.text or "").encode()), n := plain_count(r.text), n > 5) for r in edge_docs.collect())
    assert Counter(map(tuple, out.collect())) == expected
    assert token_counts.count_tokens(no_docs, BYTES).collect() == []
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(edge_docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(own.encode(r.text or ""))) for r in edge_docs.collect())


def plain_lloyd(rows, clusters=8, rounds=10, width=64, scale=1024):
    """Lists of Python's whole numbers, one vector after another."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    at = [v for _, v in sorted([r for r in kept if r[0] is not None], key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
        return min(range(len(at)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        for k in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                at[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    total, inertia = Counter(), sum(d for *_, d in found)
    for _, k, d in found:
        total[k] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    long = lambda n: n if n < 1 << 63 else None
    return Counter((i, k, long(d), long(total[k]), long(inertia), hashes[k]) for i, k, d in found)


def rows_of(df):
    return Counter(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()))


def test_op12_equals_plain_and_sql(spark):
    df = op12_lloyd_centroids(spark, SF)
    got = rows_of(df)
    assert got == plain_lloyd([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == Counter(con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({centroids.oracle()})").fetchall())


def test_op12_edges(spark):
    rng = random.Random(1)
    draw = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, draw(), "x", 1) for i in range(40)] + [(7, draw(), None, 2), (None, draw(), "y", 3), (2**62 + 1, draw(), "y", 3)]
    rows += [(50, None, "x", 1), (51, [], "x", 1), (52, [1.0, None, 0.0, 0.0], "x", 1), (53, [float("nan"), 0.0, 0.0, 0.0], "x", 1), (54, [float("inf"), 0.0, 0.0, 0.0], "x", 1), (55, [0.0] * 5, "x", 1)]
    rows += [(60, [0.5] * 4, "t", 1)] * 30  # ties and repeated rows
    schema = "vec_id bigint, embedding array<double>, cluster string, distance int"
    run = lambda given, **more: rows_of(centroids.cluster(spark.createDataFrame(given, schema).repartition(3), width=4, rounds=3, **more))
    plain = lambda given, **more: plain_lloyd([r[:2] for r in given], width=4, rounds=3, **more)
    assert run(rows, clusters=5) == plain(rows, clusters=5)
    assert run(rows[:3], clusters=8) == plain(rows[:3], clusters=8)
    assert run([], clusters=8) == Counter() and run(rows[43:49]) == Counter() and run(rows[41:42]) == Counter()
    large = [*rows, (70, [1e300, -1e300, 3.5, 1e17], "x", 1), (71, [2e9, -2e9, 0.25, 1e6], "x", 1)]
    assert run(large, clusters=6) == plain(large, clusters=6)


def plain_resample(docs, target, buckets=10_000, least=20, percent=25):
    fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    runs = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    own = [list(map(place, runs(words(t)))) for _, t in docs]
    s, t = Counter(b for o in own for b in o), Counter(place(f) for x in target for f in runs(words(x)))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets))))
    out = []
    for (i, text), o in zip(docs, own):
        weight = sum(map(gain, o)) // len(o) if o else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(o), weight, score, None, len(words(text))])
    may = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def drawn(df):
    return Counter(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()))


def test_op13_equals_plain(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert drawn(op13_importance_resampling(spark, SF)) == plain_resample([(r.doc_id, r.text) for r in docs], [r.text for r in target])


def test_op13_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("the cat and the dog", 1), (None, 2), ("", 3)], "text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for percent in (25, 60, 100, 0):
        assert drawn(importance.resample(edge_docs, target, percent=percent)) == plain_resample(rows, ["the cat and the dog", None, ""], percent=percent)
    assert drawn(importance.resample(edge_docs, target.limit(0))) == plain_resample(rows, [])
    assert importance.resample(no_docs, target).collect() == []
    many = [(5, "the cat and the dog went to the house " * 4)] * 9000 + [(6 + i, f"w{i} " * 25) for i in range(40)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string").repartition(3)
    assert drawn(importance.resample(docs, target, percent=70)) == plain_resample(many, ["the cat and the dog"], percent=70)


def test_streams_sort_and_runs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string").coalesce(1)
    expected = Counter()
    for t in texts:
        w = t.split()
        for k in (1, 2, 3):
            expected.update(zlib.crc32(" ".join(w[i : i + k]).encode()) % 100 for i in range(len(w) - k + 1))
    for size in (1, 70, 10**6):  # from a row a document to a row for all
        packed = importance.streams(rows, "bigint", 3, 100, size)
        got = importance.counted(packed, 100)
        assert {b: int(n) for b, n in enumerate(got) if n} == dict(expected)
        assert sorted(i for r in packed.collect() for i in r.ids) == list(range(60))
    with pytest.raises(ValueError):
        importance.streams(rows, "bigint", 2, 1 << 17)
    assert np.all(importance.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)) == 0)
