"""Small helpers shared by the text operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and word alphabets that the contracts fix.
SPACE = r" \t\n\x0B\f\r"
WORD_BREAK = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lociq-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one run in the shared folder. A table that is written and read back
    survives lost executors, cuts the lineage, and is a plain scan for what joins it next;
    those that are used up are dropped at once, the others with the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, shared_dir(spark), 0
        atexit.register(self.drop)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: DataFrame) -> None:
        """Deletes the tables, except those that the given ones read."""
        try:
            keep = {p.rsplit("/", 2)[-2] for df in but for p in df.inputFiles()}
            jvm = self.spark._jvm
            fs = jvm.org.apache.hadoop.fs.Path(self.at).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for k in range(1, self.n + 1):
                if str(k) not in keep:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.at}/{k}"), True)
        except Exception:  # at exit the session may be gone
            if but:
                raise


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    return Scratch(df.sparkSession).cut(df)


def digest(df: DataFrame, salt: int) -> Column:
    """63 bits of all columns and of which are null."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *df.columns, *(F.col(c).isNull() for c in df.columns)), 1)


def keyed(df: DataFrame, most_salts: int = 8) -> DataFrame:
    """df with row_key, by which a verdict on a row finds back to it where ids are null or
    repeated. Only whole copies share a key: it is 63 bits long and is held against a
    second digest, over all rows; where two rows of one key differ there, which 10^10 rows
    bring about some five times, another salt is taken. So rows would have to agree in 126
    bits to be taken for copies."""
    for salt in range(most_salts):
        key = digest(df, salt)
        both = df.select(key.alias("key"), digest(df, salt + most_salts).alias("other"))
        shared = both.groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high")
        if shared.isEmpty():
            break
    return df.withColumn("row_key", key)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
