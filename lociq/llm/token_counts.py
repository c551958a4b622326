"""Token counts by batch encoding in Arrow functions that return lengths only.

A task takes its texts as they come and packs them into batches of about `BATCH_BYTES`
bytes, whatever their number, so that what an encoder holds is bounded by bytes and not by
rows. A text of more than `PIECE_BYTES` is cut at places where its tokens part in any case
and each piece is encoded for itself: for the byte-level vocabularies, whose words begin
with the white space before them, before white space that follows a letter or number and
where letters and numbers meet. A run without any such place is one piece. Vocabularies
with another way of cutting words are given whole texts. Only lengths leave the encoder.

Null text is empty text: no bytes, no tokens. Rows are independent: repeated ids and rows
give a row each, a null id is kept, other columns are not touched.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import text_or_empty

BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 16
LIMIT = 512
#: Places where a byte-level vocabulary's words part whatever stands around them.
SAFE = re.compile(
    r"(?<=\w)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    "|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。！，？])"
)


def may_be_cut(spec: dict) -> bool:
    """Whether `SAFE` holds: words cut by the byte-level pattern alone, and special strings
    that no safe place lies in."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    return bool(plain and spec.get("normalizer") is None and not any(SAFE.search(t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added))


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of a batch, whether texts may be cut), once for each Python worker. The
    library is chosen by the file's ending."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core and no more
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    encode = getattr(made, "encode_batch_fast", made.encode_batch)
    with open(path, encoding="utf-8") as f:
        return lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)], may_be_cut(json.load(f))


def pieces(text: str, least: int = PIECE_BYTES) -> Iterator[str]:
    """The text in pieces of at least so many characters, except the last, cut at safe places."""
    at = 0
    while len(text) - at > least and (m := SAFE.search(text, at + least)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def lengths(texts: Iterator[str], n: int, count: Callable[[list[str]], list[int]], cut: bool, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """Tokens of each of n texts, encoded in batches that are balanced by bytes."""
    out, held, owners, size = np.zeros(n, dtype=np.int64), [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            np.add.at(out, owners, count(held))
        held, owners, size = [], [], 0

    for owner, text in enumerate(texts):
        for piece in pieces(text, piece_bytes) if cut and len(text) > piece_bytes else (text,):
            weight = len(piece) if piece.isascii() else len(piece.encode())
            if size + weight > batch_bytes:
                flush()
            if weight:
                held.append(piece)
                owners.append(owner)
                size += weight
    flush()
    return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row per document: n_bytes, n_tokens, and whether the tokens are more than the limit.
    `vocabulary` is a path that every executor can read, as installed with its package."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = load(vocabulary)
        for batch in batches:
            texts = batch.column("t")
            found = lengths((t.as_py() for t in texts), len(texts), count, cut)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("b"), pa.array(found)], names=["k", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("k"), F.octet_length(text).cast("bigint").alias("b"), text.alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
