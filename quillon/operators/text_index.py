"""A kept inverted index of the strings of files, searched by BM25.

Layout below a folder: ``strings/version=v`` and ``postings/version=v/bucket=b`` hold what the files of one update have, ``files/version=v`` a row
for each of these files, deleted ones too. A file's rows of its last version count, all others are passed over, so an update writes its own files'
rows and nothing else, and is there as a whole once ``files/version=v`` is; run again it replaces itself. A search knows its terms'
buckets and reads no other folder. ``compacted`` starts a folder with what is live.

A string's id is unique in its file: its line, if no other string is there, else a hash of 63 bits, below zero. Texts aren't exchanged but for strings that share
their line, and a string's terms are counted in its row, so each task writes its postings to the buckets and what an update takes is little more than the index.
A search exchanges the postings of its terms by file, and meets the texts of its best strings only.

Terms are runs of letters and digits, in lower case. A query's terms are its first 256 different ones of two signs or more, any of which may
match; the score is BM25 (k1 1.2, b 0.75) with an inverse frequency of at least a millionth.

Edge cases: strings without terms are kept and never found; a query without terms finds nothing, nor does one in an empty index; a file in an
update without strings has none from then on; equal strings of one line count once; ties go by path, line and text; null texts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import terms
from .settle import released, settled, sized

BUCKETS, TERMS, LIMIT = 64, 256, 20
K1, B, LEAST = 1.2, 0.75, 1e-6
STRINGS = "path string, line long, kind string, locale string, text string, id long, len int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(words: DataFrame) -> DataFrame:
    """``term, tf`` instead of the array ``words``, with the other columns: the runs of the sorted array, in the row."""
    others = [c for c in words.columns if c != "words"]
    run = words.where(F.size("words") > 0).select(*others, F.sort_array("words").alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    run = run.select(*others, "w", starts.alias("at"))
    one = F.transform("at", lambda x, j: F.struct(F.get("w", x).alias("term"), (F.coalesce(F.get("at", j + 1), F.size("w")) - x).cast("long").alias("tf")))
    return run.select(*others, F.inline(one))


def replace_files(folder: str, strings: DataFrame, files: DataFrame, version: int) -> None:
    """Writes an update: the files (``path``, ``deleted``) have the strings (``path, line, kind, locale, text``) from now on. Versions go up."""
    spark = strings.sparkSession
    given = strings.where("text IS NOT NULL AND path IS NOT NULL").select("path", F.col("line").cast("long").alias("line"), "kind", "locale", "text")
    # what is known without texts: lines of several strings, and files that this update doesn't keep; mostly there are few or none
    lines = settled(given.groupBy("path", "line").agg(F.count(F.lit(1)).alias("n")))
    gone, n_gone = sized(lines.select("path").distinct().join(files.where("NOT deleted").select("path").distinct(), "path", "left_anti"))
    shared, n_shared = sized(lines.where("n > 1 OR line IS NULL OR line < 0").select("path", F.col("line").alias("l")))
    if n_gone:
        given = given.join(gone, "path", "left_anti")
    own = given
    if n_shared:
        here = (given["path"] == shared["path"]) & given["line"].eqNullSafe(shared["l"])
        among = given.join(shared, here, "left_semi").distinct()
        hashed = F.xxhash64("path", "line", "kind", F.isnull("kind"), "locale", F.isnull("locale"), "text").bitwiseOR(F.lit(-(2**63)).cast("long"))
        own = given.join(shared, here, "left_anti").withColumn("id", F.col("line")).unionByName(among.withColumn("id", hashed))
    else:
        own = own.withColumn("id", F.col("line"))
    own.withColumn("len", F.size(terms(F.col("text")))).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/strings/version={version}")
    own = spark.read.schema(STRINGS).parquet(f"{folder}/strings/version={version}")
    postings = counted(own.select("path", "id", "len", terms(F.col("text")).alias("words"))).select("term", "path", "id", "len", "tf", bucket(F.col("term")).alias("bucket"))
    postings.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings/version={version}")
    sums = own.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))
    rows = files.groupBy("path").agg(F.min("deleted").alias("deleted")).join(sums, "path", "left").select("path", "deleted", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
    rows.write.mode("overwrite").parquet(f"{folder}/files/version={version}")
    released(lines, gone, shared)


def live_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, version, n, total`` of the files that live, at their last version."""
    rows = spark.read.schema("path string, deleted boolean, n long, total long, version int").parquet(f"{folder}/files")
    last = rows.groupBy("path").agg(F.max_by(F.struct("version", "deleted", "n", "total"), "version").alias("x"))
    return last.where("NOT x.deleted").select("path", "x.version", "x.n", "x.total")


def strings_of(spark: SparkSession, folder: str) -> DataFrame:
    """The live strings."""
    return spark.read.schema(f"{STRINGS}, version int").parquet(f"{folder}/strings").join(live_files(spark, folder).select("path", "version"), ["path", "version"], "left_semi")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, bucket`` of queries (``query_id, text``)."""
    words = F.filter(F.array_distinct(terms(F.col("text"))), lambda t: F.length(t) > 1)
    return queries.where("text IS NOT NULL").select("query_id", F.explode(F.slice(words, 1, TERMS)).alias("term")).distinct().withColumn("bucket", bucket(F.col("term")))


def postings_of(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """``term, path, version, id, len, tf`` of the terms asked for; only their buckets' folders are read."""
    wanted = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # BUCKETS numbers at most
    rows = spark.read.schema("term string, path string, id long, len int, tf long, version int, bucket int").parquet(f"{folder}/postings")
    rows = rows.where(F.col("bucket").isin(wanted)) if wanted else rows.limit(0)
    rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
    # files are few next to postings, and meet them by path
    return rows.join(live_files(spark, folder).select("path", "version"), ["path", "version"], "left_semi").select("term", "path", "version", "id", "len", "tf")


def search(spark: SparkSession, folder: str, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``query_id, rank, path, line, text, score``: for each query the ``limit`` best strings."""
    asked = settled(query_terms(queries))
    found = settled(postings_of(spark, folder, asked))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    all_ = live_files(spark, folder).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST))
    # a term's weight is known before any posting is joined
    weights, _ = sized(asked.join(df, "term").crossJoin(F.broadcast(all_)).select("query_id", "term", idf.alias("idf"), "avg"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = found.join(weights, "term").groupBy("query_id", "path", "version", "id").agg(F.sum(part).alias("score"))
    # the best by score and path, with those that are equal in both, are enough to find their lines and texts
    first = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "path")
    few, _ = sized(scored.withColumn("r", F.rank().over(first)).where(F.col("r") <= limit).drop("r"))
    strings = spark.read.schema(f"{STRINGS}, version int").parquet(f"{folder}/strings")
    kept = few.join(strings.select("path", "version", "id", "line", "kind", "locale", "text"), ["path", "version", "id"])
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "path", "line", "text", "kind", "locale")
    out = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", "path", "line", "text", "score")
    released(asked, found, weights)
    return out


def compacted(spark: SparkSession, folder: str, into: str) -> None:
    """Writes the live files of an index into a new folder, as its version 0."""
    replace_files(into, strings_of(spark, folder), live_files(spark, folder).select("path", F.lit(False).alias("deleted")), 0)
