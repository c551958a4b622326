"""Near-duplicates by an inverted join over MinHash coordinates.

A document's set of word shingles gives `COORDINATES` minima. A posting is a pair of a
coordinate and its value. Two documents whose sets are as similar as asked agree in at
least `MATCHES` coordinates except with a chance below one in 100,000, so only the
`COORDINATES - MATCHES + 1` rarest postings of each need be joined (the prefix), rarest
over the whole corpus; values that no other document has count among these without being
posted (the skip). Of a pair that meets under a posting the collisions are counted over all
coordinates, and it is retained from `MATCHES` on. Beside them stands a sketch of one bit from each of `SKETCH` further coordinates: similar
sets agree in `SKETCH_MATCHES` bits except with the same chance, and less similar ones
seldom do. A third filter is exact: of `PARITY` bits, each the parity of the shingles that
fall on it, two sets differ in no more than they differ in shingles, which is sharp for
texts of up to some hundred words. Candidates that pass all three are confirmed on their
full sets.

Copies of one set are one class, and only classes are joined. Each class first meets one
hub in every posting, the class whose own postings are the most common: in a group of
copies that each have changes of their own, whatever is near to some copy is nearer still
to the one with the fewest changes. So a group costs a link each and not a pair each.
In the later of `HUB_ROUNDS` rounds what is still apart meets other members of a posting's
largest component. Only pairs that lie in
different components and share a posting are then tested one by one: those outside a
posting's largest component with all its holders. A posting with many components is split: what meets there is posted anew
under the rarest shingles of its full set, of which two similar sets share one among so
many as they may differ in, and meets under these; so short texts with a common word, or
long ones with a common passage, do not all meet (`SPLIT_PAIRS`). No link between
components is lost and no pair inside a component is made.

Null text, or text without words, has no set and is linked with nothing. Texts with fewer
words than a shingle are one shingle. Rows that share an id are one document for links
and still give a row each. Ids must be integers; the smallest id names a component; a row
without an id belongs to its copies' component and is kept only where it has none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociq.llm.common import Scratch, text_or_empty
from lociq.llm.graph import components

COORDINATES, MATCHES = 32, 15
PREFIX = COORDINATES - MATCHES + 1
#: Bits of the sketch, and how many of them a similar pair shares: at a similarity of 0.8
#: each bit agrees with a chance of 0.9, and fewer than 430 do so once in 100,000 pairs.
SKETCH, SKETCH_MATCHES, PARITY = 512, 430, 1024
HUB_ROUNDS = 2
#: Pairs under a posting beyond which it is split.
SPLIT_PAIRS = 50_000
#: Postings of a class that are looked through for an earlier meeting of a pair.
HEAD = 12
#: Pairs of a block, on average, in the confirmation of links.
BLOCK_PAIRS = 20_000
#: Bits of the bitmap that picks the documents to make sets of: 16 MB.
BITS = 1 << 27
#: Remembered words of a Python worker.
CACHE_ENTRIES = 200_000
#: Documents whose results a Python worker holds at once.
ROWS_HELD = 1000

RANDOM = np.random.RandomState(20240229)
FACTORS = RANDOM.randint(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = RANDOM.randint(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64)
SKETCH_SHIFTS = RANDOM.randint(0, 2**32, SKETCH, dtype=np.int64).astype(np.uint32)
SKETCH_FACTORS = RANDOM.randint(0, 2**32, SKETCH, dtype=np.int64).astype(np.uint32) | np.uint32(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    # Bytes fold and split on ASCII alone, which is what words mean here.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(width, len(own))
    n = len(own) - width + 1
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The postings of a set: the least value of each coordinate, with the coordinate's
    number in the lowest bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            part = (found[at : at + 2048, None] ^ SHIFTS) * FACTORS
            low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0))
    return ((low & ~np.uint64(COORDINATES - 1)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit of each of `SKETCH` minima over 32-bit hashes, then the `PARITY` bits, as
    64-bit numbers."""
    low = np.full(SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 1024):
            low = np.minimum(low, ((short[at : at + 1024, None] ^ SKETCH_SHIFTS) * SKETCH_FACTORS).min(axis=0))
        bits = ((low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(31)
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(np.concatenate([bits, odd]).astype(np.uint8)).view(np.int64)


def differ(a: str, b: str, low: int, high: int) -> str:
    """SQL for the differing bits of two sketches, whose numbers are called a and b."""
    return "(" + " + ".join(f"bit_count({a.format(i)} ^ {b.format(i)})" for i in range(low // 64, high // 64)) + ")"


def agree(a: str, b: str) -> str:
    """SQL for the bits of the minima in which two sketches agree."""
    return f"({SKETCH} - {differ(a, b, 0, SKETCH)})"


def may_be_similar(a: str, b: str, percent: int) -> str:
    """SQL for what two sketches of sets of n and m shingles leave possible."""
    by_parity = f"{100 + percent}L * {differ(a, b, SKETCH, SKETCH + PARITY)} <= {100 - percent}L * (n + m)"
    return f"{agree(a, b)} >= {SKETCH_MATCHES} AND {by_parity}"


def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_HELD):
            yield batch.iloc[at : at + ROWS_HELD]


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, same, postings, sketch): set size, a digest that copies of a set share,
    the signature, and the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in held(batches):
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                found = shingles(text, width, hashes)
                if not len(found):
                    rows.append((key, 0, None, None, None))
                    continue
                postings = signature(found)
                rows.append((key, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), postings, sketch(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "same", "postings", "sketch"])

    return docs.mapInPandas(run, "doc_id bigint, n bigint, same binary, postings array<bigint>, sketch array<bigint>")


def bitmap(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the wanted ids: `BITS` / 8 bytes, whatever their number, so
    its parts come to the driver in one job, not a job a partition."""
    place = F.pmod(F.xxhash64("node"), F.lit(BITS))
    parts = wanted.select(F.floor(place / 32768).alias("part"), (place % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, found) of the wanted documents, and of the few whose hash falls on
    one of theirs; made again from the texts, which are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bits = WordHashes(), shared.value
        for batch in held(batches):
            place = batch["place"].to_numpy()
            batch = batch[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            found = [shingles(t, width, hashes) for t in batch["text"]]
            if found:
                yield pd.DataFrame({"node": batch["doc_id"].to_numpy(), "found": [x.view(np.int64) for x in found]})

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("place"))
    return rows.mapInPandas(run, "node bigint, found array<bigint>")


def together(table: DataFrame) -> DataFrame:
    """A written table in a session that lets joins use a coarser dealing of their keys."""
    spark = table.sparkSession
    other = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return other.read.schema(table.schema).parquet(*{p.rsplit("/", 1)[0] for p in table.inputFiles()}) if table.inputFiles() else other.createDataFrame([], table.schema)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar as asked.

    Pairs are dealt to a square of blocks by a's and b's hashes, about `BLOCK_PAIRS` to
    each, and a set goes once to every block that needs it: a document of very many pairs
    is spread over a row of blocks, and no pair carries sets through a shuffle."""
    sets = scratch.cut(full_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), width))
    # What lies together by block need not be dealt again by block and id: a setting of a
    # session of its own, so that no other query's plan changes.
    pairs, sets = together(pairs), together(sets)
    side = max(4, math.isqrt(pairs.count() // BLOCK_PAIRS) + 1)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = pairs.withColumn("block", place("a") * side + place("b"))
    of = lambda c: dealt.select(c, "block").distinct().join(sets.withColumnsRenamed({"node": c, "found": f"found_{c}"}), c).repartition("block")
    both = dealt.repartition("block").join(of("a"), ["block", "a"]).join(of("b"), ["block", "b"])
    shared = both.select("a", "b", (F.size("found_a") + F.size("found_b")).alias("total"), F.size(F.array_intersect("found_a", "found_b")).alias("inter"))
    alike = shared.where(F.expr(f"100L * inter >= {percent}L * (total - inter)")).select("a", "b")
    return scratch.cut(alike)


def prefixes(nodes: DataFrame, column: str, whole: str, length: str, percent: int, scratch: Scratch) -> DataFrame:
    """(posting, size_class, away, node, n, common): each class's rarest postings, under its
    own size class and, away from it, the next, which is as far as similar sets can differ
    in size; common is how many hold its postings in all. whole and length are SQL for how
    many postings the column has and how many of them are a prefix."""
    posted = nodes.select("node", F.explode(column).alias("posting"))
    shared = scratch.cut(posted.groupBy("posting").agg(F.count("*").alias("holders")).where("holders > 1"))
    held = posted.join(shared, "posting")
    rarest = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "posting"))).alias("held")).join(nodes.select("node", "n"), "node")  # a class's own postings
    # Postings that nobody else holds come first in rarity and use up the prefix.
    left = f"cast({length} - ({whole} - size(held)) AS int)"
    common = F.expr("aggregate(held, 0L, (s, h) -> s + h.holders)")
    kept = rarest.where(f"{left} > 0").select("node", "n", common.alias("common"), F.explode(F.expr(f"slice(held, 1, {left})")).alias("p"))
    step = math.log(100 / percent)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    both = F.explode(F.array(F.struct(size_class.alias("c"), F.lit(False).alias("away")), F.struct((size_class + 1).alias("c"), F.lit(True).alias("away"))))
    return kept.select(F.col("p.posting").alias("posting"), both.alias("s"), "node", "n", "common").select("posting", F.col("s.c").alias("size_class"), F.col("s.away").alias("away"), "node", "n", "common")


def hub_pairs(named: DataFrame, sketches: DataFrame, percent: int, scratch: Scratch, turn: int = 0) -> DataFrame:
    """(a, b): each class of another component than a posting's hub, with the one of its
    hubs that it agrees with best. named: posted rows with their labels, of postings with
    several labels. A hub is the class with the most common postings at first, later
    another member of the posting's largest component at each turn."""
    key = ["posting", "size_class"]
    rank = F.col("common") if turn == 0 else F.when(F.col("label") == F.col("main"), F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 1)).otherwise(-1)
    ranked = named if turn == 0 else with_largest(named)
    hubs = ranked.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("least"), "n", "label")).alias("hub"))
    hubs = hubs.select(*key, (-F.col("hub.least")).alias("b"), F.col("hub.n").alias("m"), F.col("hub.label").alias("label_b"))
    met = named.join(hubs, key).where((F.col("label") != F.col("label_b")) & F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m)"))
    met = scratch.cut(met.select(F.col("node").alias("a"), "n", "b", "m").distinct())
    sides = met.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    near = sides.where(F.expr(may_be_similar("x[{}]", "y[{}]", percent))).select("a", "b", F.expr(agree("x[{}]", "y[{}]")).alias("agreed"))
    best = near.groupBy("a").agg(F.max(F.struct("agreed", (-F.col("b")).alias("least"))).alias("best"))
    return scratch.cut(best.select("a", (-F.col("best.least")).alias("b")))


def with_largest(named: DataFrame) -> DataFrame:
    """named with main, the label of most rows of its posting, and split: whether the rows
    of others are so many that the posting is split."""
    key = ["posting", "size_class"]
    sizes = named.groupBy(*key, "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy(key).agg(F.max(F.struct("rows", "label")).alias("m"), F.sum("rows").alias("all"))
    split = (F.col("all") - F.col("m.rows")) * F.col("all") > SPLIT_PAIRS
    return named.join(largest.select(*key, F.col("m.label").alias("main"), split.alias("split")), key)


def collided(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures collide in `MATCHES` coordinates; a
    posting has its coordinate's number in it."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("postings").alias(f"p_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.size(F.array_intersect("p_a", "p_b")) >= MATCHES).select("a", "b")


def met(rows: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different labels under a posting that may be similar. Of two
    rows with different labels one lies outside the posting's largest component, so only
    such rows look for partners.

    Alike sets share many postings; a pair is left to the least of them, as far as both
    sides' `HEAD` least postings tell, so few pairs come twice. It meets there too: what
    is under that posting goes by the sizes and labels of both alone, or the posting is
    split and both are crowded."""
    key, numbers = ["posting", "size_class"], range((SKETCH + PARITY) // 64)
    rows = rows.select(*key, "away", "node", "n", "label", (F.col("label") == F.col("main")).alias("in_main"))
    rows = rows.withColumn("head", F.slice(F.array_sort(F.collect_set("posting").over(W.partitionBy("node"))), 1, HEAD))  # a class's own postings
    rows = scratch.cut(rows.join(nodes.select("node", *(F.col("sketch")[i].alias(f"x{i}") for i in numbers)), "node"))
    other = rows.select(*key, F.col("away").alias("away_b"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("label_b"), F.col("in_main").alias("main_b"), F.col("head").alias("head_b"), *(F.col(f"x{i}").alias(f"y{i}") for i in numbers))
    once = F.expr("label <> label_b AND (main_b OR node > b) AND NOT (away AND away_b)")
    fits = F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m) AND {may_be_similar('x{}', 'y{}', percent)}")
    first = F.expr("coalesce(array_min(array_intersect(head, head_b)) >= posting, true)")
    return rows.where("NOT in_main").join(other, key).where(once & fits & first).select(F.col("node").alias("a"), "b")


def meeting(rows: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of `met`, each once."""
    return met(rows, nodes, percent, scratch).distinct()


def several(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Posted rows with their labels, of the postings that several components hold."""
    key = ["posting", "size_class"]
    label = F.col("node") if labels is None else F.coalesce("label", "node")
    named = (posts if labels is None else posts.join(labels, "node", "left")).withColumn("label", label)
    held = named.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select(*key)
    return named.join(held, key, "left_semi")


def remaining_pairs(named: DataFrame, labels: DataFrame | None, nodes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different components that share a posting and may be similar."""
    rows = scratch.cut(with_largest(named))
    pairs = meeting(rows.where("NOT split"), nodes, percent, scratch)
    crowded = scratch.cut(rows.where("split").select("node").distinct())
    if not crowded.isEmpty():
        sets = full_sets(docs, crowded, width).join(crowded, "node", "left_semi").withColumn("n", F.size("found").cast("bigint"))
        again = scratch.cut(prefixes(scratch.cut(sets), "found", "n", f"n - (n * {percent} + 99) div 100 + 1", percent, scratch))
        pairs = pairs.union(meeting(with_largest(several(again, labels)), nodes, percent, scratch)).distinct()
    return scratch.cut(pairs)


def links(nodes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, label) of the classes that are linked with another."""
    cut = scratch.cut
    posts = cut(prefixes(nodes, "postings", f"{COORDINATES}", f"{PREFIX}", percent, scratch))
    labels, tested, held = None, None, posts
    for turn in range(HUB_ROUNDS + 1):
        named = cut(several(held, labels))
        held = named.drop("label")  # what one component holds stays one's
        pairs = hub_pairs(named, nodes.select("node", "sketch"), percent, scratch, turn) if turn < HUB_ROUNDS else remaining_pairs(named, labels, nodes, docs, width, percent, scratch)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(collided(pairs, nodes))
        if pairs.isEmpty():
            continue
        labels = components(confirmed(pairs, docs, width, percent, scratch), labels, scratch)
        tested = pairs.select("a", "b").union(pairs.select("b", "a")) if tested is None else tested.union(pairs.select("a", "b")).union(pairs.select("b", "a"))
    return nodes.select("node", F.col("node").alias("label")).limit(0) if labels is None else labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    seen = scratch.cut(signed(docs, width))
    nodes = scratch.cut(seen.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("postings", "sketch"))))
    labels = links(nodes, docs, width, percent, scratch)
    classes = scratch.cut(nodes.join(labels, "node", "left").select("same", F.coalesce("label", "node").alias("component")))
    scratch.drop(seen, classes)
    out = seen.select("doc_id", "n", "same").join(classes, "same", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
