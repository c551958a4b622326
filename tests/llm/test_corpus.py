"""Near-duplicates, decontamination and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociq.llm import decontaminate, near_duplicates, pii, quality_rules
from lociq.llm.graph import components

SF = "/root/testdata/sf0.001"


def sets_of(rows, width):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        w = min(width, len(words)) or 1
        out[i] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)}
    return out


def brute_components(rows, width, percent=80):
    sets, parent = sets_of(rows, width), {}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(a), root(b)
                parent[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = near_duplicates.near_duplicates(docs, width=width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components([(r.doc_id, r.text) for r in docs.collect()], width)


def test_near_copies_chains_and_large_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for i in range(60):  # a large group of near copies, each with a change of its own
        copy = list(base)
        copy[rng.randrange(60)] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(60)]
    for i in range(100, 112):  # each like the next, the ends unlike
        rows.append((i, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(60)] = word()
    rows += [(200 + i, "of the") for i in range(30)] + [(300 + i, " ".join(word() for _ in range(30)) + " of the and in the") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_duplicates.near_duplicates(docs, width=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows, 2)


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    out = near_duplicates.near_duplicates(edge_docs).collect()
    assert len(out) == edge_docs.count()
    by_id = collections.defaultdict(set)
    for r in out:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[0] == {(0, 0, True)} and by_id[1] == {(0, 1, True)} and by_id[6] == by_id[5] and by_id[4] == {(20, 4, True)}
    assert near_duplicates.near_duplicates(no_docs).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.label for r in components(edges).collect()} == {**{i: 0 for i in range(65)}, 100: 100, 101: 100}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y or x == 0))
    return row[-1]


def test_bit_parallel_edits():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randint(lo, 5) for _ in range(rng.randint(1, 30))] for lo in (1, 0))
        assert decontaminate.edits(np.array(a), np.array(b), 99) == levenshtein(a, b)


def brute_leaks(docs, items):
    out = {}
    for i, text in docs:
        words = decontaminate.words_of(text or "")
        for j, item in items:
            own = decontaminate.words_of(item or "")
            n = len(own)
            if n:
                windows = [words[s : s + n] for s in range(max(1, len(words) - n + 1))]
                least = min(levenshtein(own, w) for w in windows)
                if least <= int(decontaminate.EDITS * n):
                    out[i, j] = least
    return out


def planted(seed, changes):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(j, " ".join(prose(rng.randint(12, 30)))) for j in range(12)]
    docs = []
    for i in range(60):
        copy = items[i % 12][1].split()
        for k in rng.sample(range(len(copy)), min(changes, int(0.2 * len(copy)))):
            copy[k] = word()
        docs.append((i, " ".join((prose(15) + copy + prose(15)) if i % 2 else prose(40))))
    return docs, items


@pytest.mark.parametrize("changes", [0, 1, 3])
def test_leaks_against_brute_force(spark, changes):
    docs, items = planted(changes, changes)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    wanted = brute_leaks(docs, items)
    assert set(found) <= set(wanted) and len(found) >= 0.95 * len(wanted)
    assert changes or found == wanted


def edited(rng, words, k, kind, word):
    """words after k edits: substitutions, or deletions and insertions in equal parts."""
    copy = list(words)
    if kind == "substitutions":
        for at in rng.sample(range(len(copy)), k):
            copy[at] = word()
        return copy
    for at in sorted(rng.sample(range(len(copy)), k // 2), reverse=True):
        del copy[at]
    for _ in range(k // 2):
        copy.insert(rng.randint(1, len(copy) - 1), word())
    return copy


@pytest.mark.parametrize("kind", ["substitutions", "indels"])
@pytest.mark.parametrize("known", [False, True])
def test_recall_at_the_most_edits_of_every_length(kind, known):
    """Copies with int(0.2n) edits, the new words outside the benchmark or of it."""
    missed = {}
    for n in range(8, 61):
        rng = random.Random(n)
        items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(60)]
        word = (lambda: f"w{rng.randrange(3000)}") if known else (lambda: f"x{rng.randrange(3000)}")  # noqa: B023
        index = decontaminate.Index([(j, " ".join(words)) for j, words in enumerate(items)])
        docs = [[word() for _ in range(5)] + edited(rng, words, int(0.2 * n), kind, word) + [word() for _ in range(5)] for words in items]
        found = {(r[0], r[1]) for r in index.search([np.array([index.vocabulary[w] for w in d], dtype=np.int32) for d in docs])}
        recall = sum((j, j) in found for j in range(60)) / 60
        if recall <= 0.95:
            missed[n] = recall
    assert not missed


def test_unrelated_windows_share_few_samples():
    rng = np.random.RandomState(0)
    for n in range(8, 61):
        items, windows = (rng.randint(1, 3000, (100, n)).astype(np.int32) for _ in range(2))
        walks = decontaminate.Walks(n)
        assert decontaminate.Keys(walks, items).pairs(walks.keys(windows)).shape[1] <= 0.05 * 100 * 100, n


def test_leak_blocks_and_edges(spark, edge_docs, no_docs, monkeypatch):
    docs, items = planted(9, 0)
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id bigint, text string")
    whole = {tuple(r) for r in decontaminate.leaks(*tables).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert {tuple(r) for r in decontaminate.leaks(*tables).collect()} == whole
    own = edge_docs.where("doc_id = 4").select(F.lit(1).alias("item_id"), "text").limit(1)
    assert sorted(r.doc_id or -1 for r in decontaminate.leaks(edge_docs, own).collect()) == [-1, 4, 4, 5, 6]
    assert decontaminate.leaks(no_docs, own).collect() == [] and decontaminate.leaks(edge_docs, own.limit(0)).collect() == []
    assert decontaminate.without_leaks(edge_docs.where("doc_id IS NOT NULL"), own).columns == edge_docs.columns


def test_short_items_equal_brute_force(spark):
    """Items of one to seven words: exact up to four, with one word changed or gone from five on."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("xyz")
    items = [(j, " ".join(word() for _ in range(1 + j % 7))) for j in range(42)] + [(50, ""), (51, None), (52, "ax"), (53, "ax")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 40])))) for i in range(80)]
    for i in range(42):
        own = items[i][1].split()
        if i % 2 and len(own) > 1:
            own[rng.randrange(len(own))] = "other"
        docs.append((200 + i, " ".join(own if i % 3 else ["pre", *own, "post"])))
        docs.append((300 + i, " ".join(own[1:])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    wanted = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): r.edits for r in found.collect()} == wanted and {j for _, j in wanted} >= set(range(0, 42, 2)) | {52, 53}


def test_blocks_let_their_items_go(spark, monkeypatch):
    """Ten blocks: one broadcast at a time, and none left."""
    docs, items = planted(5, 1)
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in decontaminate.leaks(*tables).collect()}
    open_, most, plain = [], [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        out = plain(self, value)
        if isinstance(value, list):
            open_.append(out)
            most.append(len(open_))
            gone = out.destroy
            out.destroy = lambda: (open_.remove(out), gone())
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(decontaminate, "n_blocks", lambda *_: 10)
    assert {tuple(r) for r in decontaminate.leaks(*tables).collect()} == whole
    assert len(most) == 10 and max(most) == 1 and not open_


def test_keys_tell_rows_apart_that_share_a_digest(spark, monkeypatch):
    """A digest of few bits: salts are tried until different rows have different keys."""
    from pyspark.sql import functions as F

    from lociq.llm import common

    plain = common.digest
    monkeypatch.setattr(common, "digest", lambda df, salt: F.pmod(plain(df, salt), F.lit(4)) if salt == 0 else plain(df, salt))
    rows = spark.createDataFrame([(i % 20, "t" if i % 20 else None) for i in range(40)], "doc_id bigint, text string")
    got = common.keyed(rows).collect()
    assert len({r.row_key for r in got}) == 20 and len({(r.row_key, r.doc_id) for r in got}) == 20


def test_short_document_is_one_window(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = [(1, " ".join(item.split()[:18])), (2, " ".join(item.split()[:12])), (3, "lead in " + item)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, item)], "item_id bigint, text string"))
    assert {(r.doc_id, r.edits, r.first_word) for r in found.collect()} == {(1, 2, 0), (3, 0, 2)}


def test_pipeline_equals_plain_stages(spark):
    """Each stage's decisions made plainly on what the stage before it kept."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdicts = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    texts = {i: docs[i].text for i in docs if i in verdicts}
    groups = brute_components(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, t in texts.items() if any(t and x in t for _, x in items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) <= set(texts) - exact and len(out) >= 0.95 * len(set(texts) - exact)
    from lociq.llm import bpe

    _, encoder, _ = bpe.load(corpus_pipeline.vocabulary())
    model, limits = pii.trained()
    for i, r in out.items():
        assert r.ids == encoder.encode(pii.redacted(texts[i], pii.find(texts[i], model, limits)[1]))


def test_pipeline_stages_keep_columns_and_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_stages_judge_rows_and_not_ids(spark):
    """Null and repeated ids: each row stays or goes by its own text."""
    words = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) > 600").orderBy("doc_id").limit(12).collect()]
    kept = {r.text for r in corpus_pipeline.quality(spark, spark.createDataFrame([(i, "en", t) for i, t in enumerate(words)], "doc_id bigint, lang string, text string"), SF).collect()}
    a, b, c, d = [t for t in words if t in kept][:4]
    table = lambda *rows: spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id bigint, lang string, text string")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    docs = table((None, a), (None, "bad"), (1, b), (1, "bad too"), (2, c), (None, None))
    assert rows(corpus_pipeline.quality(spark, docs, SF)) == sorted([(None, a), (1, b), (2, c)], key=str)
    docs = table((None, a), (None, a), (None, b), (1, c), (1, d), (5, a + " more"), (None, d), (7, b), (3, b), (1, c), (None, None))
    assert rows(corpus_pipeline.near_duplicate_groups(spark, docs, SF)) == sorted([(5, a + " more"), (1, c), (1, d), (3, b), (None, None)], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = table((None, a), (None, f"see {item} there"), (1, b), (1, f"{item} it was"), (2, c))
    assert rows(corpus_pipeline.decontamination(spark, docs, SF)) == sorted([(None, a), (1, b), (2, c)], key=str)


def test_links_over_size_classes_and_common_postings(spark):
    """Groups whose members lie on both sides of size-class borders, that share words with
    each other and with many short texts; none of their links may be lost."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, shared = [], [word() for _ in range(25)]
    for group in range(40):
        base = [word() for _ in range(rng.choice([12, 20, 45, 90]))] + (shared if group % 2 else [])
        rng.shuffle(base)
        for _ in range(rng.randint(2, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [copy[at], word()], [copy[at], word(), word()]])
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, f"of the {word()}") for i in range(120)] + [(2000 + i, " ".join(shared)) for i in range(3)]
    # One text, and it with a few words more: alone in their size classes.
    alone = [word() for _ in range(60)]
    rows += [(3000, " ".join(alone)), (3001, " ".join(alone + [word() for _ in range(4)])), (3002, " ".join(alone + [word() for _ in range(9)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, width=width).collect()}
        assert got == brute_components(rows, width)
    assert got[3001][1] == 3000



def test_many_short_texts_on_one_posting(spark, monkeypatch):
    """Rows that are joined pair by pair grow with the texts and not with their square."""
    seen, plain = [], near_duplicates.Scratch.cut

    def watched(self, df):
        out = plain(self, df)
        if "x0" in df.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(near_duplicates.Scratch, "cut", watched)
    short = spark.range(4000).selectExpr("id AS doc_id", "concat('of the w', id) AS text")
    five = spark.range(4000).selectExpr("id + 5000 AS doc_id", "concat('of the a', id, ' b', id, ' c', id, ' d', id) AS text")
    same = "array_join(transform(sequence(1, 40), i -> concat('w', i)), ' ')"
    longer = spark.range(3000).selectExpr("id + 10000 AS doc_id", f"concat({same}, array_join(transform(sequence(1, 25), i -> concat(' v', id, '_', i)), '')) AS text")
    near = spark.range(300).selectExpr("3 * id + 10000 AS of", "id + 20000 AS doc_id").join(longer.withColumnRenamed("doc_id", "of"), "of").selectExpr("doc_id", "concat(text, ' end') AS text")
    out = near_duplicates.near_duplicates(short.union(five).union(longer).union(near), width=2)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == {**{i: i for i in [*range(4000), *range(5000, 9000), *range(10000, 13000)]}, **{20000 + i: 10000 + 3 * i for i in range(300)}}
    assert max(seen) <= 12_000, seen


def test_collisions_are_counted(spark):
    rng = random.Random(1)
    words, rows, wanted = [f"w{i}" for i in range(300)], [], {}
    for k, changed in enumerate((0, 30, 60, 80, 100, 300)):
        other = list(words)
        for i in rng.sample(range(300), changed):
            other[i] = f"x{i}"
        a, b = (near_duplicates.signature(near_duplicates.shingles(" ".join(w), 2, near_duplicates.WordHashes())) for w in (words, other))
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
        wanted[2 * k, 2 * k + 1] = int((a == b).sum())
    nodes = spark.createDataFrame(rows, "node bigint, postings array<bigint>")
    pairs = spark.createDataFrame(list(wanted), "a bigint, b bigint")
    kept = {(r.a, r.b) for r in near_duplicates.collided(pairs, nodes).collect()}
    assert kept == {p for p, n in wanted.items() if n >= near_duplicates.MATCHES} and 0 < len(kept) < len(wanted)


def test_a_pair_of_many_postings_meets_once(spark):
    """Alike texts share most postings; their pairs are made once and not for each of these."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{k}" if k != i and rng.random() < 0.03 else w for k, w in enumerate(base)) for i in range(24)]
    rows, sketches, wanted = [], [], set()
    sets = [near_duplicates.shingles(t, 2, near_duplicates.WordHashes()) for t in texts]
    for i, found in enumerate(sets):
        sketches.append((i, near_duplicates.sketch(found).tolist()))
        rows += [(int(p), c, c > 0, i, len(found), i, 0) for p in near_duplicates.signature(found) for c in (0, 1)]
    nodes = spark.createDataFrame(sketches, "node bigint, sketch array<bigint>")
    posted = spark.createDataFrame(rows, "posting bigint, size_class int, away boolean, node bigint, n bigint, label bigint, main bigint")
    made = [(r.a, r.b) for r in near_duplicates.met(posted, nodes, 80, near_duplicates.Scratch(spark)).collect()]
    for i in range(24):
        for k in range(i):
            if len(np.intersect1d(sets[i], sets[k])) * 100 >= 80 * len(np.union1d(sets[i], sets[k])):
                wanted.add((i, k))
    assert wanted and wanted <= {(max(p), min(p)) for p in made} and len(made) <= 1.2 * len(set(made))
