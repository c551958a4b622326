"""The DataFrame-only operators: rules, licences, secrets, chat pairs."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest

from lociq.llm import chat_pairs, licenses, quality_rules, secrets
from lociq.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_counts(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_quality_counts(spark, edge_docs, no_docs):
    for docs in (docs_of(spark), edge_docs):
        out = quality_rules.judge(docs)
        found = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
        assert found == sorted((r.doc_id or -1, *plain_counts(r.text or "")) for r in docs.collect())
    assert quality_rules.judge(no_docs).collect() == []


def test_quality_repeats_many_and_few(spark):
    few, many = "a b c d a b c e", " ".join(f"w{i}" for i in range(40)) + " x "
    rows = spark.createDataFrame([(1, few, "en"), (2, many * 3, "en"), (3, "a a a a a", "en"), (4, "a b", "en")], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(rows).collect()}
    assert found == {i: plain_counts(t)[4] for i, t in ((1, few), (2, many * 3), (3, "a a a a a"), (4, "a b"))}


def test_quality_verdict_follows_distance(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.5
    assert not (out.kept & (out.class_distance > quality_rules.MOST_CLASS_DISTANCE)).any()


def plain_histograms(text, lang):
    """Class and common-word counts by single characters and words."""
    import unicodedata

    classes = [0] * 8
    for c in re.sub(r"[ \t\n\x0b\f\r]", "", text):
        k = 0 if c in "aeiou" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in ".,;:!?'\"()-" else 5 if c.isascii() and c.isprintable() else 6 if unicodedata.category(c)[0] == "L" else 7
        classes[k] += 1
    words, common = WORD.findall(text), quality_rules.COMMON_WORDS.get(lang, "").split()
    wording = [words.count(w) for w in common]
    return classes, [*wording, len(words) - sum(wording)]


def plain_distance(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    mean = [(x + y) / 2 for x, y in zip(p, q)]
    kl = lambda u: sum(x * math.log2(x / m) for x, m in zip(u, mean) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_distances_equal_plain_ones(spark, edge_docs):
    for docs in (docs_of(spark), edge_docs):
        rows = docs.collect()
        name = lambda lang: lang if lang in quality_rules.COMMON_WORDS else "other"
        found, sums = [plain_histograms(r.text or "", r.lang) for r in rows], {}
        for r, hists in zip(rows, found):
            sums[name(r.lang)] = [[x + y for x, y in zip(h, s)] for h, s in zip(hists, sums.get(name(r.lang), [[0] * len(h) for h in hists]))]
        wanted = []
        for r, hists in zip(rows, found):
            by_class, by_word = (plain_distance(h, s) for h, s in zip(hists, sums[name(r.lang)]))
            n, *_, failed = plain_counts(r.text or "")
            kept = not failed and not (by_class or 0) > quality_rules.MOST_CLASS_DISTANCE and not (n >= quality_rules.WORD_LEAST_WORDS and (by_word or 0) > quality_rules.MOST_WORD_DISTANCE)
            wanted.append((r.doc_id or -1, kept, *(None if x is None else round(x, 6) for x in (by_class, by_word))))
        got = [(r.doc_id or -1, r.kept, *(None if x is None else round(x, 6) for x in (r.class_distance, r.word_distance))) for r in quality_rules.judge(docs).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)


TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_license(text):
    words = TOKEN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += hits
        labels |= {label} if hits else set()
    blocks = [b for b in (*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text))]
    sets, score = [set(TOKEN.findall(b.lower())) for b in blocks], 0.0
    every = set(labels)
    for label, template in licenses.TEMPLATES:
        own = set(licenses.words_of(template))
        best = max(len(own & s) / len(own) for s in sets)
        if best >= licenses.CONTAINMENT:
            every.add(label)
            score = max(score, best)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if labels else round(score, 9)


def test_licenses_equal_brute_force(spark, edge_docs, no_docs):
    mit = licenses.TEMPLATES[5][1]
    extra = spark.createDataFrame([(90, mit, "en"), (91, "x\n" + " ".join(mit.split()[:24]) + "\ny", "en"), (92, mit[: len(mit) // 2], "en"), (93, "CC-BY and Apache LICENSE, mit  license", "en")], "doc_id bigint, text string, lang string")
    for docs in (docs_of(spark), edge_docs, extra):
        found = sorted((r.doc_id or -1, *(x if i != 6 else round(x, 9) for i, x in enumerate(tuple(r)[1:]))) for r in licenses.scan(docs).collect())
        wanted = sorted((r.doc_id or -1, *plain_license(r.text or "")) for r in docs.collect())
        assert str(found) == str(wanted)
    assert licenses.scan(no_docs).collect() == []


def test_license_matches_equal_brute_force(spark):
    """Random blocks against random templates, in an order of rarity."""
    rng = random.Random(6)
    vocabulary = [f"w{i:02}" for i in range(30)]  # rarest first
    templates = [(t, f"l{t % 4}", sorted(rng.sample(vocabulary, rng.randint(3, 14)))) for t in range(12)]
    table = [(t, label, own, math.ceil(0.8 * len(own) - 1e-9)) for t, label, own in templates]
    blocks = [(k, sorted(set(rng.choice(templates)[2]) ^ set(rng.sample(vocabulary, rng.randint(0, 4))))) for k in range(300)]
    wanted = {}
    for k, words in blocks:
        for _, label, own, need in table:
            share = len(set(own) & set(words)) / len(own)
            if len(set(own) & set(words)) >= need:
                wanted[k, label] = max(wanted.get((k, label), 0), share)
    out = licenses.matches(spark.createDataFrame(blocks, "key bigint, words array<string>"), spark.createDataFrame(table, "template int, label string, ordered array<string>, need int"))
    assert {(r.key, r.label): r.share for r in out.collect()} == wanted and wanted


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_secrets_base_spans(spark, edge_docs, no_docs):
    tricky = ["token='token' = 'abcdefgh1'", "😀 Password : \"abcdefgh\" AKIAAKIA12345678 AKIAX", "api_key=" + "0" * 40 + " secret=short", "token=abcdefgh " * 400, "PASSWD:x token:yyyyyyyy"]
    extra = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(tricky)], "doc_id bigint, text string, source string, lang string")
    for docs in (docs_of(spark), edge_docs, extra):
        found = sorted((r.doc_id or -1, r.base_sha256) for r in secrets.scan(docs).collect())
        assert found == sorted((r.doc_id or -1, hashlib.sha256(plain_secrets(r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert secrets.scan(no_docs).collect() == []


def test_secrets_ownership_decides(spark):
    own, common = "ghp_" + "aB3d" * 6, "ghp_" + "zZ9y" * 6
    rows = [(i, f"x {common} y", f"s{i}", "en") for i in range(5)] + [(9, f"see {own}", "s1", "en"), (9, f"see {own}", "s1", "en")]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()
    assert {(r.doc_id, r.spans, r.n_live, r.n_copied) for r in out} == {*((i, "", 0, 1) for i in range(5)), (9, "vendor:4:32", 1, 0)} and len(out) == 7
    one_owner = spark.createDataFrame([(i, f"x {own} y", "s1", lang) for i, lang in enumerate(("en", "de", "fr", "es"))], "doc_id bigint, text string, source string, lang string")
    assert {(r.spans, r.n_live, r.n_copied) for r in secrets.scan(one_owner).collect()} == {("vendor:2:30", 1, 0)}


def test_secrets_spans_equal_a_plain_count_of_owners(spark):
    rng = random.Random(3)
    values = ["ghp_" + "".join(rng.choice("abcXYZ019") for _ in range(24)) for _ in range(12)] + ["Bearer " + "q" * 30, "token=" + "z" * 12]
    rows = [(i, " and ".join(rng.sample(values, rng.randint(0, 3))), rng.choice(("s1", "s2", "s3", "s4", None)), rng.choice(("en", "de", "fr", None))) for i in range(60)]
    owners, places = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, source, lang in rows:
        for v in values:
            if v in text:
                owners[v].add(source)
                places[v].add((source, lang))
    copied = {v for v in values if len(owners[v]) > 2 or len(owners[v]) > 1 and len(places[v]) > 3}
    plain = {}
    for i, text, *_ in rows:
        spans = [(text.index(v), "vendor" if v[0] == "g" else "bearer" if v[0] == "B" else "assign", text.index(v) + len(v)) for v in values if v in text and (v[0] == "t" or v not in copied)]
        plain[i] = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans))
    out = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()
    assert {r.doc_id: r.spans for r in out} == plain and 0 < len(copied) < len(values)


def test_chat_pairs_match_sql(spark):
    out = queries()["op4_preference_pairs"](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = con.sql(oracle_sql()["op4_preference_pairs"]).df()[list(out.columns)]
    assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, wanted.values.tolist()))


def test_chat_prefix_is_rendered_once(spark):
    turns = [(2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (3, 2, "user", "why"), (3, 2, "user", "why"), (4, None, None, None), (None, 0, "user", "lone"), (6, 0, "user", "same"), (7, 0, "user", "same")]
    rows = spark.createDataFrame([(*t, "p") for t in turns], "conv_id bigint, turn bigint, role string, text string, pair_id string")
    found = {(r.pair_id, r.part, r.turn, r.learn, r.paired) for r in chat_pairs.segments(chat_pairs.neighbours(rows)).collect()}
    assert found == {(1, "prompt", 0, False, True), (1, "chosen", 1, True, True), (1, "rejected", 1, True, True), (1, "rejected", 2, False, True), (2, "chosen", -1, False, False), (-1, "rejected", 0, False, False), (3, "prompt", 0, False, True)}
    assert {(r.part, r.turn, r.copies) for r in chat_pairs.segments(chat_pairs.neighbours(rows)).where("pair_id = 1").collect()} == {("prompt", 0, 1), ("chosen", 1, 1), ("rejected", 1, 1), ("rejected", 2, 2)}
    one = {r.pair_id: r for r in chat_pairs.examples(chat_pairs.neighbours(rows)).collect()}[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.rejected.endswith("<|user|>\nwhy<|end|>\n" * 2) and [x.learn for x in one.rejected_mask] == [True, False]
    assert chat_pairs.segments(chat_pairs.neighbours(rows.limit(0))).collect() == []
