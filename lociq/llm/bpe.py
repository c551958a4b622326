"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list decides every token with a bounded look to the right: whether a merge (u, v)
takes place depends on v's own formation and on merges (v, y) of a lower rank, whose own
application depends on still lower ranks, so following the list in rank order gives the
number of symbols after a token's end that can still change it (`sufficient_lookahead`).
`Transducer` keeps a window of that many symbols beyond a block, emits what is stable,
and forgets it: its memory depends on the vocabulary, never on the text. Every word goes
through it; that recent short words are remembered with what it gave saves its work and
changes nothing. `Encoder.stream` takes a text in chunks that end before white space, and
a run without any in pieces, so that words of any length pass as a stream as well.
Decoding feeds token bytes to an incremental UTF-8 state machine, and digests are taken
of ids and bytes as they come: beside the text itself nothing grows with it.

Null text is empty text: no tokens, and the digest of nothing. Rows are independent, so
repeated ids and repeated rows give a result row each; other columns are not touched.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import text_or_empty

#: Unicode white space as the vocabulary's own normaliser understands it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: Code points below this are cut with the faster of the two pattern engines.
LATIN = 0x250
#: Symbols that are encoded together once the lookahead lies behind them.
BLOCK = 1024
#: Characters of a text that are taken at a time, and of a run without white space.
CHUNK, PIECE = 1 << 16, 1 << 13
#: Token ids that are digested and decoded at a time.
STEP = 4096
#: Cached chunks and the longest cached chunk: a bound on a worker's memory.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """Vocabulary, ranks and the lookahead that the ranks imply."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = piece
        #: Rank of a pair, and the token that the merge of a rank makes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        self.length = [1] * len(self.pieces)
        self.lookahead = self.sufficient_lookahead()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE))
        letters, numbers = ("".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        latin = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        self.latin_words = re.compile(latin.replace(r"\s", WHITE))
        self.beyond_latin = re.compile(f"[^\0-{chr(LATIN - 1)}]")

    def sufficient_lookahead(self) -> int:
        """Symbols past a token's end that can still change the token, over all tokens.

        In rank order, reach[t] for the token t = u + v is the largest of: what v's
        formation needs, what u's needs beyond v, and, for each earlier merge (v, y) that
        could take v away, y's length and what that merge itself needs. The longest token
        is added because a boundary may move back by one token.
        """
        reach, taken, longest, most = {}, {}, 1, 0
        for (u, v), rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            new = self.made[rank]
            self.length[new] = self.length[u] + self.length[v]
            need = max(reach.get(v, 0), reach.get(u, 0) - self.length[v], taken.get(v, 0))
            reach[new] = max(need, reach.get(new, 0))
            taken[u] = max(taken.get(u, 0), self.length[v] + max(need, 0))
            longest, most = max(longest, self.length[new]), max(most, need)
        return most + longest

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of one finite run of symbols, lowest rank first, leftmost first."""
        if len(ids) <= 64:
            get, made, none = self.ranks.get, self.made, len(self.made)
            ids = list(ids)
            ranks = [get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (low := min(ranks)) < none:
                i = ranks.index(low)
                ids[i : i + 2] = [made[low]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), none)
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            return ids
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [x for x in ids if x >= 0]


class Transducer:
    """Encodes one word from a stream of bytes, with constant memory."""

    def __init__(self, merges: MergeList, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, []

    def feed(self, data: bytes) -> Iterator[int]:
        """Take more of the word; yield the tokens that nothing further can change."""
        limit = self.block + self.merges.lookahead
        for at in range(0, len(data), limit):
            self.held.extend(self.merges.inner[b] for b in data[at : at + limit])
            if len(self.held) >= limit:
                yield from self._stable()

    def close(self, last: int) -> Iterator[int]:
        """The word's last byte, which carries the end-of-word mark."""
        self.held.append(self.merges.last[last])
        out, self.held = self.merges.merged(self.held), []
        yield from out

    def _stable(self) -> Iterator[int]:
        reach, at = len(self.held) - self.merges.lookahead, 0
        for token in self.merges.merged(self.held):
            if at + self.merges.length[token] > reach:
                break
            at += self.merges.length[token]
            yield token
        self.held = self.held[at:]


class Remembered(dict):
    """A bounded memory in two generations: when the younger is full it becomes the older."""

    def __init__(self, make, entries: int, chars: int):
        super().__init__()
        self.make, self.entries, self.chars, self.older = make, entries, chars, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: What a word that begins with an apostrophe may be (fixed values, in their order).
CONTRACTED = re.compile("'s|'t|'re|'ve|'m|'ll|'d")
#: Starters that join with what stands before them, beside marks.
JAMO = re.compile("[\u1161-\u1175\u11a8-\u11c2]")


class Encoder:
    """Normalises, cuts into words and encodes, all as a stream; recent words are remembered."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.words = Remembered(self.word, CACHE_ENTRIES, CACHE_CHARS)
        names = sorted(merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.runs = regex.compile(rf"(?P<L>\p{{L}}+)|(?P<N>\p{{N}})|(?P<S>[^{WHITE}\p{{L}}\p{{N}}]+)")

    def word(self, word: str) -> tuple[int, ...]:
        data, machine = word.encode("utf-8", "surrogatepass"), Transducer(self.merges)
        return (*machine.feed(data[:-1]), *machine.close(data[-1]))

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # Lower case goes letter by letter here, without the final sigma of whole words.
        return text.lower()

    def plain(self, text: str) -> Iterator[tuple[int, ...]]:
        """The words of a chunk."""
        text = self.normal(text)
        cut = self.merges.words if self.merges.beyond_latin.search(text) else self.merges.latin_words
        return map(self.words.__getitem__, cut.findall(text))

    def long_run(self, pieces: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """The words of a run that comes in pieces: one word is open at a time, as a machine
        that has all of its bytes but the last."""
        kind, machine, last = "", None, 0

        def close() -> tuple[int, ...]:
            nonlocal kind, machine
            out = tuple(machine.close(last)) if kind else ()
            kind, machine = "", None
            return out

        for piece in pieces:
            text, at = self.normal(piece), 0
            while m := self.runs.search(text, at):
                found, data = m.lastgroup, m.group()
                if m.start() > at or found == "N" or found != kind:
                    yield close()
                if not kind and found == "S" and (c := CONTRACTED.match(text, m.start())):
                    found, data = "N", c.group()  # a word of its own
                at = m.start() + len(data)
                if found == "N":
                    yield self.words[data]
                    continue
                raw = data.encode("utf-8", "surrogatepass")
                if not kind:
                    kind, machine = found, Transducer(self.merges)
                else:
                    raw = bytes((last,)) + raw
                yield tuple(machine.feed(raw[:-1]))
                last = raw[-1]
            if at < len(text):
                yield close()
        yield close()

    def pieces(self, text: str, at: int, end: int) -> Iterator[str]:
        """text[at:end] in pieces that may be normalised and cut into words one by one."""
        while end - at > PIECE:
            # Neither a mark's base nor an apostrophe may be parted from what follows.
            fit = lambda k: unicodedata.category(text[k])[0] != "M" and not JAMO.match(text[k]) and "'" not in text[max(0, k - 3) : k]
            stop = next((k for k in range(at + PIECE, at, -1) if fit(k)), end)
            yield text[at:stop]
            at = stop
        yield text[at:end]

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """The words between special tokens, which never reach over a chunk's end."""
        at, n = 0, len(text)
        while at < n:
            stop = n
            if n - at > CHUNK:
                stop = max(text.rfind(c, at + 1, at + CHUNK) for c in " \n\t")
                if stop < 0:  # a long run: up to its white space
                    m = re.compile(r"[ \n\t]").search(text, at + CHUNK)
                    stop = m.start() if m else n
                    yield from self.long_run(self.pieces(text, at, stop))
                    at = stop
                    continue
            yield from self.plain(text[at:stop])
            at = stop

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """Token ids, a few at a time."""
        if self.special is None:
            yield from self.parts(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self.parts(text[at : m.start()] if at or m.start() < len(text) else text)
            yield (self.merges.special[m.group()],)
            at = m.end()
        yield from self.parts(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.stream(text)))


class Decoder:
    """Token ids to text: a byte table per token and an incremental UTF-8 state machine.

    `pieces=True` gives the vocabulary's own pieces with a blank between them, which is
    what the public library returns for a vocabulary without a decoder; otherwise the
    bytes that the pieces stand for, an end-of-word mark being a blank.
    """

    def __init__(self, merges: MergeList, pieces: bool = True, end: str = "</w>"):
        self.between = b" " if pieces else b""
        if pieces:
            self.table = [p.encode() for p in merges.pieces]
        else:
            back = {c: b for b, c in enumerate(byte_alphabet())}
            special = set(merges.special)
            self.table = [
                p.encode() if p in special else bytes(back[c] for c in p.removesuffix(end)) + b" " * p.endswith(end)
                for p in merges.pieces
            ]

    def stream(self, ids: Iterable[int], step: int = STEP) -> Iterator[str]:
        machine, table, first, ids = codecs.getincrementaldecoder("utf-8")("replace"), self.table, True, iter(ids)
        while some := list(itertools.islice(ids, step)):
            data = self.between.join([table[i] for i in some])
            yield machine.decode(data if first else self.between + data)
            first = False
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[MergeList, Encoder, Decoder]:
    """One copy for each Python worker and vocabulary."""
    with open(path, encoding="utf-8") as f:
        merges = MergeList(json.load(f))
    return merges, Encoder(merges), Decoder(merges)


def digests(text: str, encoder: Encoder, decoder: Decoder, keep: list | None = None) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and digest of what they decode to, of a text's
    stream; keep takes the ids, where they are asked for."""
    count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def passing() -> Iterator[int]:
        nonlocal count
        ids = itertools.chain.from_iterable(encoder.stream(text))
        while some := list(itertools.islice(ids, STEP)):
            count += len(some)
            of_ids.update(np.asarray(array("I", some), dtype="<u4").tobytes())
            if keep is not None:
                keep.extend(some)
            yield from some

    for piece in decoder.stream(passing()):
        of_text.update(piece.encode("utf-8"))
    return count, of_ids.hexdigest(), of_text.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per document: n_tokens, digests of the ids and of the decoded text, and the
    ids themselves where asked. `vocabulary` is a path that every executor can read, as
    installed with its package."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, encoder, decoder = load(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                ids = [] if with_ids else None
                rows.append((key, *digests(text, encoder, decoder, ids), *([np.array(ids, dtype="i4")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).mapInPandas(run, schema)
