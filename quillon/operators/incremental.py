"""Snapshots: symbol diffs, renames, keyed upserts, replacement with authority, and the lifecycle of facts.

Edge cases, where a function says nothing else: empty tables give empty tables; rows repeated in full count once wherever a key is counted; ties
of an order go by the row's other columns, so reruns agree; null keys group together and match nothing in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled


def change_of(old: Column, new: Column) -> Column:
    """The kind of change between two structs of ``sig_hash, body_hash, annotations``, either of which may be null; null if nothing changed.

    ``annotations`` is an array of which order doesn't count, null as none. Nulls equal each other: a null hash on both sides is no change. A
    changed signature comes before changed annotations, these before a changed body alone.
    """
    none = F.array().cast("array<string>")
    ann = lambda s: F.sort_array(F.coalesce(s["annotations"], none))
    sig, body = (~old[f].eqNullSafe(new[f]) for f in ("sig_hash", "body_hash"))
    ann = ~ann(old).eqNullSafe(ann(new))
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(sig & body, "api_and_body").when(sig, "api").when(ann, "contract").when(body, "body")


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``fqn, change`` between two sets of symbols (``fqn, sig_hash, body_hash`` and maybe ``annotations``), see ``change_of``; names are unique on each side."""

    def side(df: DataFrame, k: int) -> DataFrame:
        ann = F.col("annotations") if "annotations" in df.columns else F.lit(None).cast("array<string>")
        return df.select("fqn", F.struct("sig_hash", "body_hash", ann.alias("annotations")).alias(f"s{k}"))

    return side(old, 0).join(side(new, 1), "fqn", "full_outer").select("fqn", change_of(F.col("s0"), F.col("s1")).alias("change")).where(F.col("change").isNotNull())


def alone(df: DataFrame, *key: str) -> DataFrame:
    """Rows that no other row shares its key with, by partial sums, so equal boilerplate meets nowhere; nulls in keys equal each other."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*rest)).alias("__x")).where("__n = 1")
    return one.select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*df.columns)


def renames(vanished: DataFrame, appeared: DataFrame) -> DataFrame:
    """``old_fqn, new_fqn``: one to one on name, signature and body; anything ambiguous declines, and so does a symbol without one of the three."""
    key = ["name", "sig_hash", "body_hash"]
    a = alone(vanished.select("fqn", *key), *key).withColumnRenamed("fqn", "old_fqn")
    b = alone(appeared.select("fqn", *key), *key).withColumnRenamed("fqn", "new_fqn")
    return a.join(b, key).where("old_fqn <> new_fqn").select("old_fqn", "new_fqn")


def file_renames(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """``old_path, new_path`` by equal content; the deleted side must be unique, of several additions the last by name counts."""
    one = alone(deleted.select("path", "content_hash"), "content_hash")
    last = added.groupBy("content_hash").agg(F.max("path").alias("new_path"))
    return one.join(last, "content_hash").select(F.col("path").alias("old_path"), "new_path")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, refreshed by incoming ones of the same key whatever their values, and new ones; incoming rows revive deleted ones. A null key equals a null key."""
    cols = [c for c in stored.columns if c != key]
    a = stored.select(F.col(key).alias("ka"), F.struct(*cols).alias("a"))
    b = incoming.select(F.col(key).alias("kb"), F.struct(*cols).alias("b"))
    both = a.join(b, F.col("ka").eqNullSafe(F.col("kb")), "full_outer")
    return both.select(F.when(F.col("b").isNotNull(), F.col("kb")).otherwise(F.col("ka")).alias(key), *[F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in cols])


def replace_symbols(stored: DataFrame, incoming: DataFrame, files: DataFrame) -> DataFrame:
    """``stored`` after the files (``path``) were parsed anew into ``incoming``; both have ``fqn, file_path, authority, deleted`` and maybe more.

    What a file no longer has is marked deleted, a name that comes back lives again. Of the rows that claim a name, a declaration goes before
    an implementation, an incoming row before a stored one of another file, and then the last path; so an implementation never takes a
    name that lives as another file's declaration (see ``refused``), while a file always replaces its own rows. Names of no such file
    aren't touched. A null authority counts as implements; ``stored`` has a name once; no files leave it as it is.
    """
    paths = files.select(F.col("path").alias("file_path")).distinct().withColumn("__parsed", F.lit(True))
    touched = incoming.select("fqn").unionByName(stored.join(paths, "file_path", "left_semi").select("fqn")).distinct()
    cols = stored.columns
    old = stored.join(touched, "fqn", "left_semi").join(paths, "file_path", "left").withColumn("__new", F.lit(0))
    new = incoming.select(*cols).withColumn("__parsed", F.lit(False)).withColumn("__new", F.lit(1))
    both = old.select(*cols, "__parsed", "__new").unionByName(new)
    contends = (F.col("__new") == 1) | ~(F.coalesce("deleted", F.lit(False)) | F.coalesce("__parsed", F.lit(False)))
    rank = F.struct(contends, contends & F.coalesce(F.col("authority") == "declares", F.lit(False)), "__new", "file_path", F.xxhash64(*cols))
    won = both.groupBy("fqn").agg(F.max_by(F.struct(*cols, contends.alias("__live"), "__new"), rank).alias("x"))
    gone = F.when(F.col("x.__new") == 1, F.lit(False)).otherwise(~F.col("x.__live") | F.coalesce("x.deleted", F.lit(False)))
    changed = won.select(*[gone.alias(c) if c == "deleted" else F.col(f"x.{c}").alias(c) for c in cols])
    return stored.join(touched, "fqn", "left_anti").select(*cols).unionByName(changed)


def refused(after: DataFrame, incoming: DataFrame) -> DataFrame:
    """``fqn, file_path`` of incoming implementations whose name is, after ``replace_symbols``, another file's declaration."""
    held = after.where("authority = 'declares' AND NOT deleted").select("fqn", F.col("file_path").alias("__holder"))
    mine = incoming.where("authority IS NULL OR authority <> 'declares'").select("fqn", "file_path")
    return mine.join(held, "fqn").where("file_path <> __holder").select("fqn", "file_path").distinct()


def lifecycle(presence: DataFrame) -> DataFrame:
    """``fingerprint, scan_id, status`` from ``fingerprint, scan_id, present``: new, recurring, fixed, regressed, absent; repeated rows count once, as present if any is."""
    once = presence.groupBy("fingerprint", "scan_id").agg(F.max(F.coalesce("present", F.lit(False))).alias("present"))
    w = Window.partitionBy("fingerprint").orderBy("scan_id")
    before = F.lag("present").over(w)
    ever = F.coalesce(F.max("present").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    status = F.when(F.col("present") & ~ever, "NEW").when(F.col("present") & before, "RECURRING").when(F.col("present"), "REGRESSED").when(before, "FIXED").when(ever, "ABSENT")
    return once.withColumn("status", status).where("status IS NOT NULL").select("fingerprint", "scan_id", "status")


def lifecycle_of(sightings: DataFrame) -> DataFrame:
    """As ``lifecycle``, from sightings alone (``fingerprint, scan_id`` from 1 on, and ``scans``, how many there were): what lies between two of them is said by their distance."""
    w = Window.partitionBy("fingerprint").orderBy("scan_id")
    once = sightings.groupBy("fingerprint", "scan_id").agg(F.max("scans").alias("scans"))
    last, following = F.lag("scan_id").over(w), F.coalesce(F.lead("scan_id").over(w) - 1, F.col("scans"))
    own = F.when(F.col("last").isNull(), "NEW").when(F.col("scan_id") - F.col("last") == 1, "RECURRING").otherwise("REGRESSED")
    gap = F.when(F.col("until") > F.col("scan_id"), F.transform(F.sequence(F.col("scan_id") + 1, F.greatest("until", F.col("scan_id") + 1)), lambda s: F.struct(s.cast("int").alias("scan_id"), F.when(s == F.col("scan_id") + 1, "FIXED").otherwise("ABSENT").alias("status"))))
    rows = F.concat(F.array(F.struct(F.col("scan_id").cast("int").alias("scan_id"), own.alias("status"))), F.coalesce(gap, F.array().cast("array<struct<scan_id: int, status: string>>")))
    return once.withColumns({"last": last, "until": following}).select("fingerprint", F.explode(rows).alias("x")).select("fingerprint", "x.*")


def fact_versions(facts: DataFrame) -> DataFrame:
    """``fact_key, scan_id, claim, superseded_by, live``: the next version of a key supersedes it; of one scan's claims the last by text is the newest."""
    w = Window.partitionBy("fact_key").orderBy("scan_id", "claim")
    return facts.withColumn("superseded_by", F.lead("scan_id").over(w)).select("fact_key", "scan_id", "claim", "superseded_by", F.col("superseded_by").isNull().alias("live"))


def durable(validations: DataFrame, after: int = 3) -> DataFrame:
    """``fact_key, scan_id, survived, durable``: distinct scans survived so far."""
    w = Window.partitionBy("fact_key").orderBy("scan_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return validations.select("fact_key", "scan_id").distinct().withColumn("survived", F.count(F.lit(1)).over(w)).withColumn("durable", F.col("survived") >= after)


def tree_hash(files: DataFrame, *by: str) -> DataFrame:
    """``by, digest``: an order-stable digest of ``path, content_hash``, over leaves by path hash, so no task holds a whole tree."""
    line = F.concat("path", F.lit("\t"), "content_hash")
    leaves = files.groupBy(*by, F.substring(F.md5("path"), 1, 4).alias("leaf")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"))
    return leaves.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("leaf", "h"))), "\n"), 256).alias("digest"))


def mark_deleted(files: DataFrame, symbols: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables (``path`` or ``file_path``, ``deleted``) with the files of ``gone`` (``path``) and their symbols marked; marks stay."""
    paths = gone.select(F.col("path").alias("__gone")).where("__gone IS NOT NULL").distinct()

    def marked(df: DataFrame, path: str) -> DataFrame:
        return df.join(paths, F.col(path) == F.col("__gone"), "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.col("__gone").isNotNull()).drop("__gone")

    return marked(files, "path"), marked(symbols, "file_path")


def replace_edges(stored: DataFrame, incoming: DataFrame, symbols: DataFrame) -> DataFrame:
    """Stored edges but those that files of ``incoming`` supplied (``file_path``), and the incoming ones from symbols that live."""
    live = symbols.where(~F.coalesce("deleted", F.lit(False))).select(F.col("fqn").alias("src")).distinct()
    kept = stored.join(incoming.select("file_path").distinct(), "file_path", "left_anti")
    return kept.select(*stored.columns).unionByName(incoming.join(live, "src", "left_semi").select(*stored.columns))


def append_once(ledger: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The ledger and the rows of keys that it hasn't; of rows of one key the one with the least hash. Nulls in keys equal each other."""
    k = F.struct(*key)
    new = rows.groupBy(k.alias("__k")).agg(F.min_by(F.struct(*ledger.columns), F.xxhash64(*ledger.columns)).alias("__x"))
    there = ledger.select(k.alias("__t")).distinct()
    return ledger.unionByName(new.join(there, F.col("__k").eqNullSafe(F.col("__t")), "left_anti").select("__x.*"))


def display_ids(stored: DataFrame, new: DataFrame, by: str, prefix: str, order: str) -> DataFrame:
    """``new`` with ``uid``: numbers go on from the greatest of each group in ``stored`` (``by, uid``), in order, ties by a hash of the row."""
    number = F.regexp_extract("uid", "([0-9]+)$", 1).try_cast("long")
    last = stored.groupBy(F.col(by).alias("__by")).agg(F.max(number).alias("__last"))
    cols = new.columns
    # numbered within ranges of the order, with the ranges' sizes added up, so no task sorts a whole group
    spread = new.repartitionByRange(F.col(by), F.col(order), F.xxhash64(*cols)).withColumn("__part", F.spark_partition_id())
    spread = settled(spread)
    sizes = spread.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select(F.col(by).alias("__b"), F.col("__part").alias("__p"), (F.sum("__size").over(Window.partitionBy(by).orderBy("__part")) - F.col("__size")).alias("__before"))
    i = F.row_number().over(Window.partitionBy(by, "__part").orderBy(order, F.xxhash64(*cols)))
    numbered = spread.withColumn("__i", i).join(before, F.col(by).eqNullSafe(F.col("__b")) & (F.col("__part") == F.col("__p"))).withColumn("__i", F.col("__i") + F.col("__before")).select(*cols, "__i")
    out = numbered.join(last, F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.withColumn("uid", F.concat(F.lit(prefix), (F.coalesce("__last", F.lit(0)) + F.col("__i")).cast("string"))).drop("__i", "__by", "__last")


def alias_of(renames_: DataFrame, names: DataFrame, depth: int = 16) -> DataFrame:
    """``fqn, now``: the present name of each (``fqn``) by renames (``old_fqn, new_fqn``), followed to their end or so many steps."""
    now = names.select("fqn", F.col("fqn").alias("now")).distinct()
    step = renames_.select("old_fqn", "new_fqn").groupBy("old_fqn").agg(F.max("new_fqn").alias("new_fqn"))
    for _ in range(depth):
        moved = settled(now.join(step, F.col("now") == F.col("old_fqn"), "left").select("fqn", F.coalesce("new_fqn", "now").alias("now"), F.col("new_fqn").isNotNull().alias("moved")))
        now = moved.select("fqn", "now")
        if moved.where("moved").isEmpty():
            break
    return now
