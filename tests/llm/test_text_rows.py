"""BPE, personal data, quality scores and pages: each against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from lociq.llm import bpe, discriminant, html_text, pii
from lociq.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected_bpe(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())


def test_bpe_matches_the_library_on_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(docs, vocabulary()).collect()}
    assert found == {r.doc_id: expected_bpe(library, r.text) for r in docs.collect()}


def test_bpe_edges(spark, edge_docs, no_docs, library):
    found = sorted(tuple(r) for r in bpe.encode_documents(edge_docs.where("doc_id IS NOT NULL"), vocabulary()).collect())
    assert found == sorted((r.doc_id, *expected_bpe(library, r.text)) for r in edge_docs.where("doc_id IS NOT NULL").collect())
    assert bpe.encode_documents(no_docs, vocabulary(), with_ids=True).collect() == []
    assert bpe.encode_documents(edge_docs, vocabulary(), with_ids=True).count() == edge_docs.count()


@pytest.mark.parametrize("text", ["ΑΣ ΣΟΦΟΣ", "İstanbul Ǆ ǅ", "a<|endoftext|>b", "é ½ Ⅷ ²", "x\x1cy\x0bz\x85w", "'s'S it'll", "日本語👍🏽", "x" * 5000, "ab" * 3000, "!" * 3000, "ﬁ ſ K"])
def test_bpe_unusual_texts(library, text):
    merges, encoder, decoder = bpe.load(vocabulary())
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_streams_equal_the_library_for_any_chunks(library, monkeypatch):
    rng = random.Random(8)
    encoder, decoder = bpe.load(vocabulary())[1:]
    signs = ["a", "the", "Σ", "é", "e\u0301", "\u0301\u0323", "'s", "'", "''re", "7", "½", "!?", "日本", "각", "\u1100\u1161\u11a8", "👍🏽", "\xa0", "\u3000", "<|endoftext|>", "İ", "<|", "\r"]
    for chunk, piece in ((40, 16), (7, 5), (1 << 16, 1 << 13)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "PIECE", piece)
        for spaces in (0, 1, 12):
            for _ in range(60):
                text = "".join(rng.choice(signs + [" ", "\n"] * spaces) for _ in range(rng.randint(1, 120)))
                ids = library.encode(text, add_special_tokens=False).ids
                assert encoder.encode(text) == ids, (chunk, text)
                assert bpe.digests(text, encoder, decoder) == expected_bpe(library, text)


def test_bpe_memory_does_not_grow_with_the_text():
    import tracemalloc

    encoder, decoder = bpe.load(vocabulary())[1:]
    peaks = []
    for n in (1, 8):
        for text in ("some words of a text " * (20_000 * n), "abcdefghij" * (20_000 * n)):
            tracemalloc.start()
            bpe.digests(text, encoder, decoder)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[2] < 1.5 * peaks[0] + 1_000_000 and peaks[3] < 1.5 * peaks[1] + 1_000_000


def test_transducer_emits_what_the_whole_word_gives():
    merges, encoder, _ = bpe.load(vocabulary())
    rng = random.Random(3)
    assert 0 < merges.lookahead < 1000
    for n in (1, 2, 50, 700, 5000):
        data = bytes(rng.choice(b"abcdethinrsaou") for _ in range(n))
        machine, out = bpe.Transducer(merges, block=16), []
        for i in range(n - 1):
            out += machine.feed(data[i : i + 1])
            assert len(machine.held) <= 16 + merges.lookahead
        out += machine.close(data[-1])
        assert out == merges.merged([*(merges.inner[b] for b in data[:-1]), merges.last[data[-1]]])


def test_decoder_gives_text_back():
    merges, encoder, _ = bpe.load(vocabulary())
    assert bpe.Decoder(merges, pieces=False).decode(encoder.encode("héllo wörld 😀")).split() == ["héllo", "wörld", "😀"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            out += [(*m.span(), kind)] * ok
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_pii_base_spans_equal_plain_patterns(spark, edge_docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789. -+()@ab") for _ in range(80)) for _ in range(1500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    found = {(r.doc_id, r.base_sha256, r.n_email) for r in pii.find_documents(edge_docs).collect()}
    assert found == {(r.doc_id, digest(pii.joined(plain_spans(r.text or "")).encode()), 0) for r in edge_docs.collect()}


def test_pii_candidates_are_calibrated_and_add_only():
    model, limits = pii.trained()
    found = pii.examples(1500, seed=77)
    p = model.predict(np.array([pii.features(*e[:4]) for e in found]))
    said = p >= np.array([limits[e[3]] for e in found])
    truth = np.array([e[4] for e in found], dtype=bool)
    assert truth[said].mean() >= 0.97 and said[truth].mean() >= 0.9
    base, spans = pii.find("call (212) 555-0187 or mail ann@mail.example.com, ssn 123-45-6789", model, limits)
    assert {s[2] for s in base} == {"email"} and set(base) <= set(spans) and {"phone", "ssn"} <= {s[2] for s in spans}


def test_pii_takes_whole_written_out_names():
    model, limits = pii.trained()
    name = "a.very.long.name_of_someone-" * 4 + "end"
    text = f"write to {name} [at] example [dot] com today"
    assert (9, text.index(" today"), "email") in pii.find(text, model, limits)[1]
    assert pii.redacted(text, pii.find(text, model, limits)[1]) == "write to [EMAIL] today"


def test_pii_redaction_keeps_columns(edge_docs, no_docs):
    assert pii.redacted("to a.b@c.de now", pii.base_spans("to a.b@c.de now")) == "to [EMAIL] now"
    out = pii.redact_documents(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert pii.redact_documents(no_docs).collect() == [] and pii.find_documents(no_docs).collect() == []


@pytest.mark.parametrize("n", [100_000])
def test_pii_scans_are_linear(n):
    model, limits = pii.trained()
    for text in ("a" * n, "1" * n, "a@" * n, "+1" * n, "1." * n, "(" * n, "at " * n, "1 " * n):
        pii.find(text, model, limits)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = discriminant.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.predicted == out.quality).mean() >= 0.95) and out.score.between(0, 1).all()


def test_quality_scores_equal_a_plain_discriminant(spark):
    """Two Gaussians by their textbook form: determinant and inverse, on plain sums."""
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: np.array(discriminant.statistics(r.text or "")) for r in docs.collect()}
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    sides = {y: np.array([v for v, q in known if q == y]) for y in (0, 1)}
    total, d = sum(map(len, sides.values())), len(discriminant.NAMES)
    own = {y: np.cov(v, rowvar=False, bias=True) for y, v in sides.items()}
    pooled = sum(len(v) * own[y] for y, v in sides.items()) / total
    pooled = (1 - discriminant.TO_DIAGONAL) * pooled + discriminant.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    log = {}
    for y, v in sides.items():
        w = len(v) / (len(v) + d) * (1 - discriminant.TO_POOLED)
        cov = w * own[y] + (1 - w) * pooled
        log[y] = lambda u, m=v.mean(0), c=cov, n=len(v): np.log(n / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (u - m) @ np.linalg.inv(c) @ (u - m)
    for r in discriminant.classify(docs, labels).collect():
        u = x[r.doc_id]
        assert abs(r.score - 1 / (1 + np.exp(np.clip(log[0](u) - log[1](u), -500, 500)))) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)


def test_quality_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = discriminant.classify(edge_docs, none).collect()
    assert len(out) == edge_docs.count() and {r.score for r in out} == {0.5}
    odd = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (8, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    assert discriminant.classify(edge_docs, odd).where("score BETWEEN 0 AND 1").count() == edge_docs.count()
    assert discriminant.classify(no_docs, odd).collect() == []


PAGE = """<html><head><title>no</title><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies to be the best of the web.</div><main><h1>T &amp; T</h1><p>Hello <b>big</b>&nbsp;world<br>two</p>
<aside>Side of the</aside><p>Short.<form><label>Name</label><input></form><section class="comments"><p>I think that this is good</p></section></main><footer>c</footer>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (3, "v", "", "x"), (4, "w", "<p>one<script>x", "x"), (5, "z", "<" * 2000, "x")], "page_id bigint, url string, html string, text string")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(rows).collect()}
    assert found[1] == ("u", "T & T\nHello big world two\nShort.", 32)
    assert found[2] == (None, "", 0) and found[3] == ("v", "", 0) and found[4][1] == "one"
    assert html_text.extract(rows).count() == 6 and html_text.extract(rows.limit(0)).collect() == []


def test_pages_without_article_go_by_stop_words():
    good = "This is the story of a man that was in the house and it was for the best of all that he had to be there. "
    page = f"<body><ul><li><a href=a>Alpha</a><li><a href=b>Beta</a></ul><h2>Head</h2><p>{good * 3}</p><p>Yes.</p><p>{good * 3}</p><div>{'Lorem ipsum dolor ' * 20}</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", (good * 3).strip(), "Yes.", (good * 3).strip()]


def test_articles_of_the_table(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        pieces = (" ".join(html.unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert html_text.main_text(r.html) == "\n".join(p for p in pieces if p)


def test_pages_with_broken_markup_keep_their_text():
    assert html_text.main_text('<article><p data-x="a>Broken quotes end here</p><p>More of the text</p></article>') == "Broken quotes end here\nMore of the text"
    assert html_text.main_text('<article><p title="1 > 0">Whole</p><p data-h=\'<b class="x">\'>Two</p></article>') == "Whole\nTwo"
    assert html_text.main_text('<article><div class="share-price">The price of it</div></article>') == "The price of it"
    assert html_text.main_text('<article><div class="share">Lone text of a page</div></article>') == "Lone text of a page"
    assert html_text.main_text('<article><p>Text</p><div class="share-buttons">Tell a friend</div><div id="cookieNotice">c</div></article>') == "Text"
    long = "It was the best of times and it was the worst of times, as we said before all of it. "
    assert html_text.main_text(f'<article><p>{long}<a href="x">open</p><p>{long * 2}</p><a name=y><p>{long * 2}</p></article>').count("\n") == 2
    assert html_text.main_text("<p>" + long * 4 + "<b and no end") == (long * 4).strip()


@pytest.mark.parametrize("shape", ["<a ", "<a href=\"", "<div>", "</p>", "<a 'x>", "<script", "<head>", "</script", "<!-- ", "<p class=", "&amp;", "a=", "<a href=x>", "<p a=\"b>c", "<x"])
def test_pages_take_time_by_their_length(shape):
    import time

    began = time.perf_counter()
    html_text.main_text(shape * (1_000_000 // len(shape)))
    html_text.main_text("<p " + shape * (500_000 // len(shape)) + ">" + "<div>" * 50_000 + shape * (250_000 // len(shape)) + "</p>" * 50_000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("digits", [5000, 1_000_000])
def test_pii_long_digit_runs(digits):
    """Whole numbers of any length in every branch that reads digits."""
    zeros, nines = "0" * digits, "9" * digits
    assert pii.base_spans(f"{zeros}.0.0.0") == [(0, digits + 6, "ip")]
    assert pii.base_spans(f"1.2.3.{zeros}7") == [(0, digits + 7, "ip")]
    assert pii.base_spans(f"{nines}.0.0.0") == [] and pii.base_spans(f"+{nines}") == [] and pii.base_spans(nines) == []
    assert pii.base_spans(f"a@{nines}.{zeros}") == [(0, 2 * digits + 3, "email")]
    model, limits = pii.trained()
    for text in (zeros, f"({nines}", f"+{zeros}.{nines}", " ".join([nines[:3]] * (digits // 4)), "1234-" * (digits // 5), "GB12 " + "1234 " * (digits // 5), "ab:" * (digits // 3)):
        pii.find(text, model, limits)


def shapes_around():
    """Reader comments, adverts and notices in the usual shapes of blogs and forums, and the
    words that must not come out."""
    item = '<span class="author">Ann</span> <time>May 1</time> <p>Nice words here</p>'
    yield f'<article class="comment">{item}</article>'
    yield f'<article class="comment-body" id="div-comment-3">{item}</article>'
    yield f'<article itemtype="https://schema.org/Comment">{item}</article>'
    yield f'<ol class="commentlist"><li class="comment-body">{item}</li><li class="comment-body">{item}</li></ol>'
    yield '<ol class="comment-list"><li class="comment even thread-even depth-1">Nice words here</li></ol>'
    for name in ("user-comment", "post-comments", "comment-text", "discussion", "newsletter-signup", "paywall-notice", "adsbygoogle", "commentlist", "comments", "comments-area", "ad-slot", "cookie-notice"):
        yield f'<div class="{name}">Nice words here</div>'
        yield f'<section id="{name}"><h3>Join in</h3><p>Nice words here</p></section>'
    yield '<div itemprop="comment">Nice words here</div>'
    yield '<div role="comment">Nice words here</div>'
    yield '<div hidden>Nice words here</div>'
    yield '<p style="color:red; display: none">Nice words here</p>'
    # Words with a part of their own: the form decides.
    yield f'<div class="zebra-comment-7x">{item}</div>'
    yield '<div class="zebra-comment">Nice words here</div><div class="zebra-comment">Nice words there</div>'
    yield '<div class="leave-comment-now"><p>Nice words here</p><textarea></textarea></div>'


@pytest.mark.parametrize("shape", list(shapes_around()))
def test_comments_and_notices_go(shape):
    text = "The first of the words that are in the text of it, and so they are for all to read and to hear. " * 4
    kept = text.strip()
    assert html_text.main_text(f"<body><article><p>{text}</p>{shape}</article></body>") == kept
    assert html_text.main_text(f"<body><article><p>{text}</p></article>{shape}</body>") == kept
    assert html_text.main_text(f"<body><div><p>{text}</p></div>{shape}</body>") == kept


def test_article_text_with_like_words_stays():
    text = "The first of the words that are in the text of it, and so they are for all to read and to hear. " * 4
    kept = text.strip()
    for opening in ('<article class="post has-comments comments-open">', '<article class="commentary">', '<div class="commentary-page"><article>', '<div class="zebra-comment-layout"><article><h1></h1>', '<article><div class="comment-of-the-week-story">', '<article><div class="share-price">', '<article><div class="menu-of-the-day">', '<article data-x="hidden">', '<article><div class="hidden-gem">'):
        assert html_text.main_text(f"<body>{opening}<p>{text}</p>") == kept, opening
    assert html_text.main_text(f'<article><p title="a hidden b" class=x>{text}</p></article>') == kept
