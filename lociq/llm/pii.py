"""Personal data: exact base patterns, and further spans chosen by boosted trees.

Base spans follow fixed patterns and checks (`base_spans`). Beyond them, generators of
high recall propose overlapping candidates: digit groups, written-out addresses, numbers
of identity papers. Boosted trees see each candidate's format and context; a threshold
per generator, calibrated on held-out examples to a stated precision, selects. Selected
candidates that overlap are settled by score, base spans always stay.

No table holds labels for personal data, so the trees learn from `examples()`: a seeded
set of formats with contexts, of documented size, the same on every run.

Null text is empty text and has no spans. Each row stands for itself: repeated ids and
rows give a result each. Offsets are code points, ends are exclusive. Every scan is linear
in the text's length.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.boosting import BoostedTrees
from lociq.llm.common import text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBER, DOTTED = re.compile(r"[0-9]++"), re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches without overlap, found from each at-sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        after = DOMAIN.match(text, at)
        start = at
        if after:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            done = after.end()
            yield start, done, "email"
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[Span]:
    """Dotted runs are taken whole, so that a long run of digits is read once; within one,
    the leftmost matches are its numbers by fours."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(NUMBER.finditer(text, *run.span()))
            for i in range(0, len(parts) - 3, 4):
                if all(len(n) <= 3 and int(n or 0) <= 255 for n in (p.group().lstrip("0") for p in parts[i : i + 4])):
                    yield parts[i].start(), parts[i + 3].end(), "ip"


def base_spans(text: str) -> list[Span]:
    """The four base kinds, sorted by start and then by kind as listed."""
    out = list(emails(text))
    if DIGIT.search(text):
        out += addresses(text)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


#: High recall, bounded width; they may overlap each other and ordinary numbers. Each
#: starts with a class or a literal, which the pattern engine skips to; what must not
#: stand before it is looked at afterwards.
GENERATORS: tuple[tuple[str, re.Pattern, str], ...] = (
    ("phone", re.compile(r"[(0-9][0-9 ().-]{7,19}(?<=[0-9])(?![0-9A-Za-z])"), ".+("),
    ("card", re.compile(r"[0-9]{4}(?:[./_ -][0-9]{3,6}){2,4}(?![0-9A-Za-z])"), ""),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), "-"),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])"), ""),
    ("ip", re.compile(r"[0-9a-fA-F]{1,4}(?::{1,2}[0-9a-fA-F]{1,4}){3,7}(?![0-9A-Za-z:])"), ":"),
    ("email", re.compile(r" ?[\[({ ](?:at|AT)[\])} ] ?[A-Za-z0-9-]{2,40}(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z]{2,10}(?!\w)"), ""),
)
#: What must stand in a text before a generator is worth running.
NEEDS = {"phone": DIGIT, "card": DIGIT, "ssn": re.compile("-[0-9]{2}-"), "iban": DIGIT, "ip": re.compile(":[0-9a-fA-F:]{1,5}:"), "email": re.compile(r"at[\])} ]|AT[\])} ]")}
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
#: Words before a candidate that speak for a kind (fixed values).
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "sms"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ip": ("ip", "host", "server", "address", "ipv6"),
    "email": ("mail", "email", "contact", "write", "reach"),
}
AGAINST = ("version", "isbn", "order", "invoice", "page", "total", "sum", "date", "build", "id", "ref")
WORD = re.compile(r"[a-z0-9]+")
CONTEXT = 32


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before = text[start:end], set(WORD.findall(text[max(0, start - CONTEXT) : start].lower()))
    digits = "".join(DIGIT.findall(span))
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    marks = [c for c in span if not c.isalnum()]
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        len(set(marks)),
        len(marks),
        float("(" in span) + float("[" in span) + float("{" in span),
        float("." in span),
        float("-" in span),
        float(" dot " in span.lower() or "dot]" in span.lower() or "dot)" in span.lower()),
        float(bool(digits) and luhn(digits)),
        float(len(set(digits)) <= 2),
        float(digits[:2] in ("19", "20")),
        float(sum(c.isalpha() for c in span)),
        float(any(c in before for c in CUES[kind])),
        float(any(c in before for k in CUES if k != kind for c in CUES[k])),
        float(any(c in before for c in AGAINST)),
        float(start > 0 and text[start - 1] in "#$=/:_"),
        float(end < len(text) and text[end : end + 1] in "%/:_="),
    ]


def proposed_by(kind: str, pattern: re.Pattern, barred: str, text: str) -> Iterator[Span]:
    done = 0
    for m in pattern.finditer(text):
        start, end = m.span()
        if kind == "email":
            first = start  # the whole name before it, which belongs to one match only
            while first > done and text[first - 1] in NAME:
                first -= 1
            done = end
            if start - first >= 2:
                yield first, end, kind
        elif not start or not (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in barred):
            yield start, end, kind


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Proposals that touch no base span."""
    digits, out = DIGIT.search(text), []
    for kind, pattern, barred in GENERATORS:
        if digits if NEEDS[kind] is DIGIT else NEEDS[kind].search(text):
            out += proposed_by(kind, pattern, barred, text)
    if not out or not taken:
        return out
    starts, ends = np.array([s for s, _, _ in taken]), np.maximum.accumulate([e for _, e, _ in taken])
    return [c for c in out if (k := np.searchsorted(starts, c[1])) == 0 or ends[k - 1] <= c[0]]


#: Training examples; a parameter of the method, not of the data.
EXAMPLES, SEED, PRECISION = 6000, 11, 0.98


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, int, str, int]]:
    """Texts with one candidate each: (text, start, end, kind, is personal)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice(("an", "er", "th", "in", "on", "re", "st", "le")) for _ in range(rng.randint(1, 4)))

    def card(sep: str) -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    positive = {
        "phone": lambda: rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(3)} {d(4)}")),
        "card": lambda: card(rng.choice("./_")),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: f"{rng.choice(('DE', 'FR', 'ES', 'GB'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        "ip": lambda: ":".join("%x" % rng.randrange(1, 65536) for _ in range(8)),
        "email": lambda: rng.choice((f"{w()}.{w()} [at] {w()} [dot] com", f"{w()} (at) {w()} (dot) org", f"{w()} at {w()} dot net")),
    }
    negative = {
        "phone": lambda: rng.choice((f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}", d(rng.randint(8, 19)), d(16), f"{d(2)}.{d(2)}.{rng.randint(1900, 2099)}", f"{d(1)}.{d(7)}", f"{d(4)} {d(4)}", f"{d(1)} {d(1)} {d(1)} {d(1)} {d(1)}", f"{rng.randint(1900, 2099)} - {rng.randint(1900, 2099)}")),
        "card": lambda: rng.choice((f"{d(4)}.{d(4)}.{d(4)}", f"{rng.randint(1900, 2099)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}_{d(3)}_{d(3)}")),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: rng.choice((f"AB{d(2)}{d(8)}", f"XK{d(2)} {d(4)} {d(4)}", f"NO{d(10)}")),
        "ip": lambda: rng.choice((f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}:{d(1)}:{d(1)}")),
        "email": lambda: rng.choice((f"{w()} at {w()}. {w().title()}", f"{w()} at {w()}.{w()}", f"looked at {w()} . {w()}")),
    }
    out = []
    for _ in range(n):
        kind, label = rng.choice(list(positive)), int(rng.random() < 0.4)
        span = (positive if label else negative)[kind]()
        if kind == "ssn":  # only the cue tells these apart
            cue = rng.choice(CUES[kind]) if label else rng.choice((*AGAINST, w()))
        elif label:
            cue = rng.choice(CUES[kind]) if rng.random() < 0.6 else w()
        else:
            cue = rng.choice(AGAINST) if rng.random() < 0.4 else w()
        head = f"{w()} {w()} {cue}{rng.choice((' ', ': '))}"
        text = f"{head}{span} {w()} {w()}"
        found = [c for g in GENERATORS if g[0] == kind for c in proposed_by(*g, text) if c[0] >= len(head) - 12 and c[1] > len(head)]
        if found:
            out.append((text, *found[0], label))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and per generator the least threshold of the stated precision on the
    fifth of the examples that the trees have not seen."""
    found = examples()
    x = np.array([features(t, s, e, k) for t, s, e, k, _ in found])
    y = np.array([label for *_, label in found], dtype=float)
    held = np.arange(len(y)) % 5 == 0
    model = BoostedTrees().fit(x[~held], y[~held])
    p, kinds, limits = model.predict(x[held]), x[held][:, 0], {}
    for kind, *_ in GENERATORS:
        own = kinds == KINDS.index(kind)
        cuts = [c for c in np.linspace(0.5, 0.99, 50) if (hit := p[own] >= c).any() and y[held][own][hit].mean() >= PRECISION]
        limits[kind] = float(min(cuts, default=1.01))
    return model, limits


def find(text: str, model: BoostedTrees, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    proposed = candidates(text, base)
    if not proposed:
        return base, base
    scores = model.predict(np.array([features(text, *c) for c in proposed]))
    chosen: list[Span] = []
    for score, span in sorted(zip(scores, proposed), key=lambda x: (-x[0], order(x[1]))):
        if score >= limits[span[2]]:
            chosen.append(span)
    kept: list[Span] = []
    taken = np.zeros(len(text) + 1, dtype=bool) if len(chosen) > 1 else None
    for span in chosen:
        if taken is None or not taken[span[0] : span[1]].any():
            kept.append(span)
            if taken is not None:
                taken[span[0] : span[1]] = True
    return base, sorted(base + kept, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes one tag of its first kind."""
    out, at, done = [], 0, 0
    for start, end, kind in sorted(spans, key=order):
        if start >= done:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = done = end
        else:
            at = done = max(done, end)
    return "".join([*out, text[at:]])


def find_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """A row per document: base counts and digest, all spans, and the redacted text where
    asked."""
    model, limits = trained()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *["redacted"] * redact]
    schema = f"{id_col} {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string" + ", redacted string" * redact

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                base, spans = find(text, model, limits)
                kinds = [s[2] for s in base]
                rows.append((key, *map(kinds.count, BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), *([redacted(text, spans)] if redact else [])))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).mapInPandas(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced by tags; all columns stay, lengths follow."""
    model, limits = trained()
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.copy()
            batch.columns = names
            batch[text_col] = [t if t is None else redacted(t, find(t, model, limits)[1]) for t in batch[text_col]]
            yield batch

    out = docs.mapInPandas(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in names else out
