"""Byte ranges of files as rows, and block-compressed sorted text with an index
(K01, S07, S11, S12).

Where something stands in a file is a column, worked out with DataFrame functions from an
index; a task then reads the ranges of its rows and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.sources.blocks import Index, Reader, Writer, bins_over, opened


def read_ranges(rows: DataFrame, keys: tuple[str, ...], out: str = "text") -> DataFrame:
    """(keys, text) of rows (keys, path, offset, length): the bytes that stand there. Rows
    are dealt by file and place, so that a task reads on; ranges of no length are empty."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict = {}
        for batch in batches:
            texts = []
            for path, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                if path not in files:
                    if len(files) >= 16:
                        files.popitem()[1].close()
                    files[path] = opened(path)
                files[path].seek(int(offset))
                texts.append(files[path].read(int(length)).decode("utf-8", "replace"))
            yield pd.DataFrame({**{k: batch[k] for k in keys}, out: texts})
        for f in files.values():
            f.close()

    dealt = rows.select(*keys, "path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out} string")


def fasta_ranges(regions: DataFrame, fai: DataFrame, path: str) -> DataFrame:
    """regions (region_id, chr, start, end) with the bytes that hold them, by the lines'
    geometry (S11): path, offset, length. Ends are cut to the contig."""
    df = regions.join(fai.select("chr", F.col("length").alias("_n"), F.col("offset").alias("_at"), "line_bases", "line_width"), "chr")
    at = lambda c: F.col("_at") + F.floor(c / F.col("line_bases")) * F.col("line_width") + c % F.col("line_bases")
    start, end = F.least(F.greatest("start", F.lit(0)), F.col("_n")), F.least(F.greatest("end", F.lit(0)), F.col("_n"))
    length = F.when(end > start, at(end - 1) + 1 - at(start)).otherwise(0)
    return df.select("region_id", F.lit(path).alias("path"), at(start).cast("bigint").alias("offset"), length.cast("bigint").alias("length"))


def fetch_fasta(regions: DataFrame, fai: DataFrame, path: str) -> DataFrame:
    """(region_id, seq) of regions of an indexed FASTA file; of the file only their bytes
    are read (S11)."""
    found = read_ranges(fasta_ranges(regions, fai, path), ("region_id",), "seq")
    return found.withColumn("seq", F.regexp_replace("seq", r"\s", ""))


def offset_index(spark: SparkSession, path: str, key, pattern: str | None = None) -> DataFrame:
    """(key, path, offset, length) of a text file's lines (S12), key being a column of
    `value`; of the lines that match a pattern where given. A line's place is the bytes
    before it: those of the lines, and of their ends, as they are numbered."""
    from lociq.operators.intervals import running_sum
    from lociq.sources.text_formats import line_numbers

    lines = line_numbers(spark.read.option("lineSep", "\n").text(path)).select("line", "value", (F.octet_length("value") + 1).cast("bigint").alias("n"), F.lit(0).alias("file"))
    placed = running_sum(lines, "file", "line", "n", "upto")
    rows = placed if pattern is None else placed.where(F.col("value").rlike(pattern))
    return rows.select(key.alias("key"), F.lit(path).alias("path"), (F.col("upto") - F.col("n")).alias("offset"), (F.col("n") - 1).alias("length"))


def write_indexed(df: DataFrame, path: str, line, parts: int | None = None) -> None:
    """Lines in genome order, block-compressed, with one index (K01). df has chr, start and
    end; line is a column. Each range of the order is a file of blocks; its task keeps the
    virtual offsets of its lines by bin, and the index is all files' bins as one table."""
    ordered = ("chr", "start", "end")
    rows = df.select(*ordered, line.alias("line"))
    dealt = rows.repartitionByRange(parts, *ordered) if parts else rows.repartitionByRange(*ordered)
    dealt = dealt.sortWithinPartitions(*ordered, "line").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, index, part = Writer(), Index(), None
        for batch in batches:
            for chr_, start, end, text, part in batch.itertuples(index=False):
                begin = writer.at
                writer.write(text.encode() + b"\n")
                index.add(chr_, start, end, begin, writer.at)
        if part is None:
            return
        data = writer.close()
        # Files travel as rows of pieces, which Spark writes where it writes everything.
        chunks = [(part, c, b, x, y) for c, bins in index.bins.items() for b, held in bins.items() for x, y in held]
        yield pd.DataFrame([(*c, None) for c in chunks], columns=["part", "chr", "bin", "begin", "past", "data"])
        yield pd.DataFrame([(part, None, None, None, None, data)], columns=["part", "chr", "bin", "begin", "past", "data"])

    kind = dict(df.dtypes)["chr"]
    made = dealt.mapInPandas(run, f"part int, chr {kind}, bin int, begin bigint, past bigint, data binary")
    made.write.mode("overwrite").parquet(f"{path}/_made")
    made = df.sparkSession.read.parquet(f"{path}/_made")
    made.where("data IS NULL").drop("data").coalesce(1).sortWithinPartitions("chr", "bin", "part", "begin").write.mode("overwrite").parquet(f"{path}/index")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for part, data in zip(batch["part"], batch["data"]):
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                system.create_dir(at, recursive=True)
                with system.open_output_stream(f"{at}/part-{part:05d}.gz", compression=None) as f:
                    f.write(data)
            yield pd.DataFrame({"part": batch["part"]})

    made.where("data IS NOT NULL").select("part", "data").mapInPandas(put, "part int").count()


def read_indexed(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """(region_id, line) of the lines that may overlap regions (region_id, chr, start, end):
    those of the chunks of their bins. Lines hold their own places, which a caller checks."""
    import numpy as np

    @F.pandas_udf("array<int>")
    def over(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([np.fromiter(bins_over(s, e), dtype=np.int32) for s, e in zip(starts, ends)])

    wanted = regions.select("region_id", "chr", F.explode(over("start", "end")).alias("bin"))
    chunks = wanted.join(spark.read.parquet(f"{path}/index"), ["chr", "bin"]).groupBy("region_id", "part").agg(F.array_sort(F.collect_set(F.struct("begin", "past"))).alias("chunks"))  # a few a bin
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for region, part, chunks in batch.itertuples(index=False):
                joined: list[list[int]] = []
                for c in chunks:  # chunks of several bins may share lines
                    if joined and c["begin"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], c["past"])
                    else:
                        joined.append([c["begin"], c["past"]])
                for begin, past in joined:
                    reader, lines = Reader(f"{path}/part-{part:05d}.gz", begin, past), []
                    while reader.more():
                        lines.append(reader.line().decode().rstrip("\n"))
                    reader.close()
                    yield pd.DataFrame({"region_id": [region] * len(lines), "line": lines})

    return chunks.mapInPandas(run, f"region_id {kinds['region_id']}, line string")
