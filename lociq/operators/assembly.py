"""From the reads of a container to calls: consensus by column votes, realignment, signals,
primitives, patterns, composites and calls in one plan, with an audit (G11, G13, G14, K20).

Members of a cluster are aligned to its medoid only; every aligned base votes for its
column, or, where it is inserted, for a rank past one; a column takes what most members
have there. One task does all of this for a cluster; a deep one's seeds and votes are rows,
so it is split by its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.dna import reverse_complement
from lociq.operators import aligner, alignments, calls, patterns, signals
from lociq.operators.graph import cut

#: Reads of a cluster that are fewer stand for it by their medoid.
LEAST_READS = 3


def medoids(reads: DataFrame, k: int = aligner.SEED, w: int = aligner.WINDOW) -> DataFrame:
    """(cluster_id, read_id): the read whose seeds most other reads share on average; the
    one of median length where no read is long enough for a seed. The lesser id in a tie.
    reads: (cluster_id, read_id, seq)."""
    tiles = aligner.tiled(reads.select(F.struct("cluster_id", "read_id").alias("target"), "seq"), overlap=k + w - 2)
    own = aligner.minimisers(tiles.select("target.*", "tile", "seq"), ("cluster_id", "read_id"), k, w).select("cluster_id", "read_id", "hash").distinct()
    held = own.groupBy("cluster_id", "hash").agg(F.count("*").alias("n"))
    shared = own.join(held, ["cluster_id", "hash"]).groupBy("cluster_id", "read_id").agg(F.avg("n").alias("mean"))
    middle = reads.groupBy("cluster_id").agg(F.expr("percentile(length(seq), 0.5)").alias("middle"))
    facts = reads.where("length(seq) > 0").join(shared, ["cluster_id", "read_id"], "left").join(middle, "cluster_id")
    rank = F.struct(-F.coalesce("mean", F.lit(0.0)), F.abs(F.length("seq") - F.col("middle")), "read_id")
    return facts.groupBy("cluster_id").agg(F.min(rank).alias("m")).select("cluster_id", F.col("m.read_id").alias("read_id"))


def packed(*columns: np.ndarray) -> np.ndarray:
    """One number for each row, alike where all columns are."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c.astype(np.int64) - int(c.min())
        span = int(c.max()) + 1
        if int(key.max()) >= (1 << 62) // span:
            key = np.unique(key, return_inverse=True)[1]
        key = key * span + c
    return key


def cells(cigars: list[str], starts: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, column, rank and letter of all that the alignments have in a column or past it.
    letters: those of all sequences, one after the other."""
    text = np.frombuffer(" ".join(["", *cigars]).encode("utf-8"), np.uint8)
    row = np.cumsum(text == 32) - 1
    digit, op = (text >= 48) & (text < 58), np.isin(text, np.frombuffer(b"MIDNSHP=X", np.uint8))
    ends = np.flatnonzero(op & np.concatenate([[False], digit[:-1]]))
    size = np.zeros(len(ends), np.int64)
    for back, ten in enumerate(10 ** k for k in range(18)):
        at = np.maximum(ends - 1 - back, 0)
        ends_on = digit[at] if not back else ends_on & digit[at]
        if not ends_on.any():
            break
        size += np.where(ends_on, (text[at].astype(np.int64) - 48) * ten, 0)
    kind, of = text[ends], row[ends]
    is_ = lambda ops: np.isin(kind, np.frombuffer(ops, np.uint8))
    on_read, on_ref = np.where(is_(b"MI=XSH"), size, 0), np.where(is_(b"MDN=X"), size, 0)

    def before(spent: np.ndarray) -> np.ndarray:
        sums = np.cumsum(spent) - spent
        return sums - sums[np.searchsorted(of, of)]

    read, ref, used = before(on_read), before(on_ref) + starts[of], is_(b"MID=X")
    kind, of, size, read, ref = kind[used], of[used], size[used], read[used], ref[used]
    inserted, deleted = kind == ord("I"), kind == ord("D")
    if (~deleted & (size > 0) & (read + size > lengths[of])).any():
        raise ValueError("an alignment is longer than its sequence")
    block = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    column = np.where(inserted[block], ref[block] - 1, ref[block] + i)
    place = (np.cumsum(lengths) - lengths)[of[block]] + read[block] + i
    gap = deleted[block]
    letter = np.where(gap, ord("-"), letters[np.where(gap, 0, place)] if len(letters) else ord("-"))
    return of[block], column, np.where(inserted[block], i + 1, 0), letter


#: Letters of reads, and of CIGARs, that a Python worker turns into cells at a time.
LETTERS = 1 << 20


def counted(aligned: DataFrame) -> DataFrame:
    """(cluster_id, column, rank, base, n, own) of stretches of the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = (batch["seq"].str.len() + batch["cigar"].str.len()).to_numpy()
            for _, rows in batch.groupby(np.cumsum(sizes) // LETTERS, sort=False):
                lengths = rows["seq"].str.len().to_numpy().astype(np.int64)
                letters = np.frombuffer("".join(rows["seq"]).encode("utf-32-le", "surrogatepass"), np.uint32)
                of, column, rank, letter = cells(rows["cigar"].tolist(), rows["pos"].to_numpy(), letters, lengths)
                if not len(of):
                    continue
                # Rows come sorted: a cluster is a stretch of them.
                cluster = np.cumsum((rows["cluster_id"] != rows["cluster_id"].shift()).to_numpy())
                key = packed(cluster[of], column, rank, letter)
                if key.max() > 4 * len(key):
                    key = np.unique(key, return_inverse=True)[1]
                held = np.bincount(key)
                kinds, first = np.flatnonzero(held), np.zeros(len(held), np.int64)
                first[key] = np.arange(len(key))  # any one of a kind
                first, n = first[kinds], held[kinds]
                own = np.bincount(key[rows["own"].to_numpy().astype(bool)[of]], minlength=len(held))[kinds] > 0
                bases = pd.Series(letter[first]).map({int(x): chr(x) for x in np.unique(letter)})
                yield pd.DataFrame({"cluster_id": rows["cluster_id"].to_numpy()[of[first]], "column": column[first], "rank": rank[first], "base": bases, "n": n, "own": own})

    kind = aligned.schema["cluster_id"].dataType.simpleString()
    return aligned.mapInPandas(run, f"cluster_id {kind}, column bigint, rank int, base string, n bigint, own boolean")


def votes(aligned: DataFrame) -> DataFrame:
    """(cluster_id, column, rank, base, n, own): how many members have a base in a column,
    or '-' for none; rank over 0 counts what is inserted past it. own: whether the medoid
    is one of them. aligned: (cluster_id, pos, cigar, seq, own), seq in the direction of
    the target; what lacks a place, CIGAR or sequence has no vote.

    Members of a cluster lie together, so that their bases are counted where they are and
    only the counts are shuffled; a deep cluster may be parted, and its counts are added."""
    rows = aligned.select("cluster_id", F.col("pos").cast("bigint").alias("pos"), "cigar", "seq", F.coalesce("own", F.lit(False)).alias("own")).dropna(subset=["pos", "cigar", "seq"])
    dealt = rows.hint("rebalance", F.col("cluster_id")).sortWithinPartitions("cluster_id")
    return counted(dealt).groupBy("cluster_id", "column", "rank", "base").agg(F.sum("n").alias("n"), F.max("own").alias("own"))


def elected(votes_: DataFrame) -> DataFrame:
    """(cluster_id, column, rank, base): the base that most members have, the medoid's in a
    tie, then the lesser; what is inserted stays where more than half of those that reach
    the column have it. Columns that most members lack go."""
    # Dealt by columns once; the votes, which may be alignments, are worked out once too.
    best = votes_.repartition("cluster_id", "column").groupBy("cluster_id", "column", "rank").agg(F.max_by("base", F.struct("n", "own", -F.ascii("base"))).alias("base"), F.sum("n").alias("n"))
    columns = best.groupBy("cluster_id", "column").agg(F.max(F.expr("CASE WHEN rank = 0 THEN n END")).alias("cover"), F.collect_list(F.struct("rank", "base", "n")).alias("ranks"))  # an insertion's length
    kept = columns.select("cluster_id", "column", "cover", F.inline("ranks"))
    return kept.where("(rank = 0 AND base <> '-') OR (rank > 0 AND 2 * n > coalesce(cover, 0))").select("cluster_id", "column", "rank", "base")


def voted_by_rows(reads: DataFrame, least: int = LEAST_READS, **how) -> DataFrame:
    """`consensuses` with seeds and votes as rows, so that a cluster is as many tasks as it
    asks for."""
    central = cut(medoids(reads).join(reads, ["cluster_id", "read_id"]).withColumnRenamed("read_id", "medoid"))
    sizes = reads.groupBy("cluster_id").agg(F.count("*").alias("members"))
    many = sizes.where(F.col("members") >= least).select("cluster_id")
    asked = reads.join(many, "cluster_id", "left_semi").join(central.select("cluster_id", F.col("medoid").alias("read_id")), ["cluster_id", "read_id"], "left_anti")
    queries = asked.select(F.struct("cluster_id", "read_id").alias("query"), F.col("cluster_id").alias("target"), "seq")
    found = aligner.align(queries, central.select(F.col("cluster_id").alias("target"), "seq"), within=True, **how).where(F.col("flag").bitwiseAND(2048) == 0)
    placed = found.join(queries.select("query", "seq"), "query").select(F.col("target").alias("cluster_id"), "pos", "cigar", F.when(F.col("flag") == 16, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.lit(False).alias("own"))
    own = central.select("cluster_id", F.lit(0).cast("bigint").alias("pos"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "seq", F.lit(True).alias("own"))
    letters = elected(votes(placed.unionByName(own)))
    # A consensus is as long as its reads: its letters are gathered as one row.
    spelt = letters.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "rank", "base"))), lambda x: x["base"]), "").alias("sequence"))
    return spelt.join(central.select("cluster_id", "medoid"), "cluster_id").join(sizes, "cluster_id")


#: Letters of a cluster up to which one task has it.
DEEP = 1 << 26


def seeds_of(seq: str, k: int, w: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`aligner.minimisers` of one sequence: (hash, at, forward)."""
    found = [aligner.minimisers_of(seq[t : t + size + k + w - 2], k, w) for t in range(0, len(seq), size)]
    value, at, forward = (np.concatenate(x) for x in ([f[0] for f in found], [f[1] + t * size for t, f in enumerate(found)], [f[2] for f in found]))
    at, first = np.unique(at, return_index=True)
    return value[first], at, forward[first]


def best_chain(asked, length: int, known, k: int, band: int, unseeded: int, gap: int, least: int):
    """(r_low, r_high, forward, q, r): the first of `aligner.chosen` of a query's chains on
    one target, or None. asked: seeds of the query; known: those of the target, by hash."""
    value, at, forward = asked
    low, high = np.searchsorted(known[0], value, "left"), np.searchsorted(known[0], value, "right")
    of = np.repeat(np.arange(len(value)), high - low)
    there = np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[of]
    same, r_all = forward[of] == known[2][there], known[1][there]
    q_all, best = np.where(same, at[of], length - k - at[of]), None
    for way in (False, True):
        q, r = q_all[same == way], r_all[same == way]
        if len(q) < least:
            continue
        order = np.lexsort((r, r - q))
        q, r = q[order], r[order]
        group = np.concatenate([[0], np.cumsum(np.diff(r - q) > band)])
        order = np.lexsort((q, r, group))
        q, r, group = q[order], r[order], group[order]
        on_r, on_q = np.diff(r), np.abs(np.diff(q))
        apart = (np.minimum(on_r, on_q) > unseeded) | (on_r > gap) | (np.diff(group) > 0)
        edges = [0, *(np.flatnonzero(apart) + 1), len(q)]
        for number, (i, j) in enumerate(zip(edges, edges[1:])):
            n = len(np.unique(q[i:j]))
            if n >= least:
                first, last = int(q[i:j].min()), int(q[i:j].max()) + k
                span = (first, last) if way else (length - last, length - first)
                rank = (-n, int(r[i]), way, *span, number)
                if best is None or rank < best[0]:
                    best = rank, (int(r[i]), int(r[j - 1]), way, q[i:j], r[i:j])
    return best and best[1]


def spelt(of, column, rank, letter, own) -> dict[int, str]:
    """`elected` of cells, as the sequence of each cluster number."""
    key = packed(of, column, rank, letter)
    _, first, where, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    own = np.bincount(where, weights=own) > 0
    of, column, rank, letter = of[first], column[first], rank[first], letter[first].astype(np.int64)
    fresh = lambda *by: np.flatnonzero(np.concatenate([[True], np.any([np.diff(x) != 0 for x in by], axis=0)]))
    starts = fresh(of, column, rank)
    place = np.repeat(np.arange(len(starts)), np.diff([*starts, len(of)]))
    best = np.lexsort((-letter, own, n, place))[np.append(starts[1:], len(of)) - 1]  # the last of each place
    of, column, rank, letter, n = of[starts], column[starts], rank[starts], letter[best], np.add.reduceat(n, starts)
    columns = fresh(of, column)
    cover = np.repeat(np.where(rank[columns] == 0, n[columns], 0), np.diff([*columns, len(of)]))
    kept = np.where(rank == 0, letter != ord("-"), 2 * n > cover)
    of, letter = of[kept], letter[kept]
    clusters = fresh(of) if len(of) else []
    return {int(of[i]): letter[i:j].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(clusters, [*clusters[1:], len(of)])}


def voted(
    clusters: list[pd.DataFrame], fewest: int, k: int = aligner.SEED, w: int = aligner.WINDOW, most: int = aligner.MOST_PLACES, size: int = aligner.TILE,
    band: int = aligner.BAND, unseeded: int = aligner.UNSEEDED, gap: int = aligner.GAP, least: int = aligner.LEAST_SEEDS,
) -> list[tuple]:
    """(cluster's number, sequence, medoid, members) of clusters (read_id, seq): all that
    `voted_by_rows` does, where the reads lie."""
    from lociq.functions.dna import turned

    about, chains, alignments_ = [], [], []
    for number, rows in enumerate(clusters):
        ids, seqs = rows["read_id"].tolist(), rows["seq"].tolist()
        lengths = [len(s) for s in seqs if s is not None]
        middle, usual = float(np.median(lengths)) if lengths else 0.0, [seeds_of(s, aligner.SEED, aligner.WINDOW, aligner.TILE) if s else None for s in seqs]
        own = [np.unique(x[0]) if x is not None else np.zeros(0, np.int64) for x in usual]
        hashes, held = np.unique(np.concatenate(own), return_counts=True) if own else (None, None)
        mean = [int(held[np.searchsorted(hashes, x)].sum()) / len(x) if len(x) else 0.0 for x in own]
        ranks = [(-mean[i], abs(len(s) - middle), ids[i], i) for i, s in enumerate(seqs) if s]
        if not ranks:
            continue
        medoid = min(ranks)[3]
        target, plain = seqs[medoid], (k, w, size) == (aligner.SEED, aligner.WINDOW, aligner.TILE)
        about.append((number, ids[medoid], len(rows)))
        alignments_.append((number, 0, f"{len(target)}M", target, True))
        if len(rows) < fewest:
            continue
        value, at, forward = usual[medoid] if plain else seeds_of(target, k, w, size)
        order = np.argsort(value, kind="stable")
        _, of, times = np.unique(value[order], return_inverse=True, return_counts=True)
        order = order[times[of] <= most]
        known = value[order], at[order], forward[order]
        for i, seq in enumerate(seqs):
            if i == medoid or not seq or len(seq) < k:
                continue
            found = best_chain(usual[i] if plain else seeds_of(seq, k, w, size), len(seq), known, k, band, unseeded, gap, least)
            if found:
                r_low, r_high, way, q, r = found
                reach = min(len(seq), aligner.TAIL) + k + aligner.PIECE_BAND
                begin = max(r_low - reach, 0)
                chains.append((number, begin, (seq if way else turned(seq), target[begin : r_high + reach], q, r - begin, k)))
    for i in range(0, len(chains), 256):
        some = chains[i : i + 256]
        for (number, begin, row), (at_, cigar, _) in zip(some, aligner.align_chains([x[2] for x in some])):
            alignments_.append((number, begin + at_, cigar, row[0], False))
    if not about:
        return []
    numbers, starts, cigars, seqs, own = zip(*alignments_)
    letters = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    of, column, rank, letter = cells(list(cigars), np.array(starts, np.int64), letters, np.array([len(x) for x in seqs], np.int64))
    sequences = spelt(np.array(numbers)[of], column, rank, letter, np.array(own)[of])
    return [(number, sequences[number], medoid, n) for number, medoid, n in about if number in sequences]


def consensuses(reads: DataFrame, least: int = LEAST_READS, deep: int = DEEP, **how) -> DataFrame:
    """(cluster_id, sequence, medoid, members): the voted sequence of each cluster, in the
    direction of its medoid (G11). A cluster of fewer reads is its medoid's sequence. Reads
    that do not align to the medoid have no vote; how: as `aligner.align` takes it.

    A cluster's reads are shuffled once, to the task that does all that is asked of them;
    clusters past `deep` letters, and those with letters past ASCII, go by rows."""
    reads = cut(reads.select("cluster_id", "read_id", F.upper("seq").alias("seq")).where("cluster_id IS NOT NULL"))
    large = cut(reads.groupBy("cluster_id").agg(F.sum(F.length("seq")).alias("n"), F.max(F.octet_length("seq") > F.length("seq")).alias("odd")).where((F.col("n") > deep) | F.col("odd")).select("cluster_id"))
    parted = bool(large.head(1))
    own = reads.join(large, "cluster_id", "left_anti") if parted else reads
    kinds = dict(reads.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held, letters = None, [], 0

        def done() -> pd.DataFrame:
            rows = voted(held, least, **how)
            names = ["cluster_id", "sequence", "medoid", "members"]
            return pd.DataFrame([(held[i]["cluster_id"].iloc[0], *rest) for i, *rest in rows], columns=names)

        for batch in chain(batches, [None]):  # at last what waits
            rows = waiting if batch is None else batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            edges = [0, *(np.flatnonzero((rows["cluster_id"] != rows["cluster_id"].shift()).to_numpy()[1:]) + 1), *([len(rows)] if batch is None else [])]
            for i, j in zip(edges, edges[1:]):
                held.append(rows.iloc[i:j])
                letters += sum(len(x) for x in rows["seq"].iloc[i:j] if x)
                if letters >= LETTERS:
                    yield done()
                    held, letters = [], 0
            waiting = rows.iloc[edges[-1] :]
        if held:
            yield done()

    # By a struct: no join deals by it, so a cluster is whole in its task.
    dealt = own.repartition(F.struct("cluster_id")).sortWithinPartitions("cluster_id")
    out = dealt.mapInPandas(run, f"cluster_id {kinds['cluster_id']}, sequence string, medoid {kinds['read_id']}, members bigint")
    return out.unionByName(voted_by_rows(cut(reads.join(large, "cluster_id", "left_semi")), least, **how)) if parted else out


def primitives(consensus: DataFrame, contigs: DataFrame, min_signal: int = 30, min_break: int = 200, within: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """(signals, breaks) of consensuses realigned to their contigs.

    consensus: (consensus_id, target, sequence, core_start, core_end), the core in places on
    the sequence; contigs: (target, seq). signals: (consensus_id, alignment, chr, start,
    end, read_start, size, sv_type) that touch the core; breaks in the columns of
    `patterns.quads`, numbered along the consensus."""
    queries = consensus.select(F.col("consensus_id").alias("query"), *(["target"] if within else []), F.col("sequence").alias("seq"))
    found = aligner.align(queries, contigs, within=within, **how)
    records = aligner.as_alignments(found).withColumnRenamed("qname", "consensus_id")
    placed = calls.alignment_numbers(signals.located(records), ("read_start", "read_end", "rname", "ref_start"))
    placed = cut(signals.with_signals(placed, min_signal, min_break))
    core = placed.join(consensus.select("consensus_id", "core_start", "core_end"), "consensus_id").withColumnRenamed("rname", "chr")
    spans = alignments.core_intervals(core)
    single = placed.select("consensus_id", "alignment", F.col("rname").alias("chr"), "forward", F.col("ref_start").alias("aln_start"), F.col("ref_end").alias("aln_end"), F.inline("sv_signals"))
    touching = alignments.core_signals(single.withColumnsRenamed({"ref_start": "start", "ref_end": "end"}), spans)
    marked = touching.select("consensus_id", "alignment", "chr", "start", "end", "read_start", "size", "sv_type", "forward", "aln_start", "aln_end")
    edges = marked.where("sv_type >= 3")
    from pyspark.sql import Window as W

    order = W.partitionBy("consensus_id").orderBy("read_start", "alignment", F.when(F.col("forward"), F.col("sv_type")).otherwise(-F.col("sv_type")))
    breaks = edges.select("consensus_id", F.row_number().over(order).alias("ord"), "chr", F.col("start").alias("ref"), F.col("read_start").alias("read"), "forward", "alignment", "aln_start", "aln_end")
    return marked.where("sv_type < 3").drop("forward", "aln_start", "aln_end"), breaks


def found_patterns(single: DataFrame, breaks: DataFrame) -> DataFrame:
    """(pattern_id, consensus_id, svtype, chr, start, end, size): gaps of one alignment as
    INS and DEL, and consensuses of exactly four breaks as inversions (G15). The id is the
    consensus, the kind and the place along it, so it is the same on every run."""
    gaps = single.select("consensus_id", F.when(F.col("sv_type") == 0, "INS").otherwise("DEL").alias("svtype"), "chr", "start", "end", F.col("size").cast("bigint"), F.col("read_start").alias("at"))
    places = breaks.groupBy("consensus_id").agg(F.min(F.struct("chr")).alias("c"), F.sort_array(F.collect_list("ref")).alias("refs"), F.min("read").alias("at"))  # four are wanted
    turned = patterns.quads(breaks).join(places, "consensus_id").select("consensus_id", F.col("pattern").alias("svtype"), "c.chr", F.col("refs")[1].alias("start"), F.col("refs")[2].alias("end"), F.col("size").cast("bigint"), "at")
    every = gaps.unionByName(turned)
    return every.select(F.concat_ws(":", F.col("consensus_id").cast("string"), "svtype", F.col("at").cast("string")).alias("pattern_id"), "consensus_id", "svtype", "chr", "start", "end", "size")


def called(reads: DataFrame, contigs: DataFrame, min_alt_reads: int = calls.MIN_ALT_READS, **limits) -> tuple[DataFrame, DataFrame]:
    """(calls, audit): reads of clusters, consensus, realignment, signals in the core,
    patterns, composites and calls (G13, G14, G17). reads: (cluster_id, target, read_id,
    seq); contigs: (target, seq). A pattern without a repeat is a composite of its own, and
    all members of its cluster support it. audit: (stage, consensus_id, reason), a row for
    each consensus that a stage has left without anything to go on with (K20)."""
    built = cut(consensuses(reads))
    where = reads.groupBy("cluster_id").agg(F.min("target").alias("target"))
    consensus = built.join(where, "cluster_id").select(F.col("cluster_id").alias("consensus_id"), "target", "sequence", "members", F.lit(0).cast("bigint").alias("core_start"), F.length("sequence").cast("bigint").alias("core_end"))
    single, breaks = primitives(consensus, contigs, **limits)
    single, breaks = cut(single), cut(breaks)
    found = cut(found_patterns(single, breaks))
    composites = found.select(F.col("pattern_id").alias("composite_id"), "svtype", "size", F.array("consensus_id").alias("consensus_ids"), F.lit(0).alias("n_repeats"))
    genotypes = found.join(consensus, "consensus_id").select(F.col("pattern_id").alias("composite_id"), F.lit("sample").alias("sample"), F.col("members").alias("n_alt"))
    places = found.select(F.col("pattern_id").alias("composite_id"), "chr", "start", "end")
    out = calls.assembled(composites, genotypes, places, min_alt_reads)

    lost = lambda stage, left, ids, reason: left.select(F.lit(stage).alias("stage"), "consensus_id").distinct().join(ids.select("consensus_id").distinct(), "consensus_id", "left_anti").select("stage", "consensus_id", F.lit(reason).alias("reason"))
    named = reads.select(F.col("cluster_id").alias("consensus_id"))
    signals_ = single.select("consensus_id").union(breaks.select("consensus_id"))
    kept = out.select(F.explode("consensus_ids").alias("consensus_id"))
    audit = lost("consensus", named, consensus, "no read with bases").unionByName(lost("signals", consensus, signals_, "no signal in the core"))
    audit = audit.unionByName(lost("patterns", signals_, found, "breaks of no known pattern")).unionByName(lost("calls", found, kept, "type or size not called"))
    return out, audit
