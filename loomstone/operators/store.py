"""Tables with write-once and claim semantics, as snapshots: a new version is written beside the old, then a pointer moves."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

CLAIM_HOURS = 4
#: Scoring failures in a row after which a posting isn't tried again.
MOST_FAILURES = 5
BOOKKEEPING = ("duplicate_of", "notified_at", "discarded_at", "discard_reason", "score_failures", "last_score_failed_at", "claimed_at", "claimed_by")
#: Bookkeeping of new rows that isn't null.
DEFAULTS = {"score_failures": 0}


def latest(batch: DataFrame, key: str, pos: str) -> DataFrame:
    """Of each key the last row of a batch, with the first sighting of its first row and whether more came.

    One aggregation; the row with the highest position wins, so nothing is sorted.
    """
    rest = [c for c in batch.columns if c != key]
    found = batch.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("r"), F.min_by("first_seen_at", pos).alias("f"), F.count("*").alias("sightings"))
    return found.select(key, *(F.col(f"r.{c}").alias(c) for c in rest if c != "first_seen_at"), F.col("f").alias("first_seen_at"), "sightings")


def upsert(table: DataFrame, batch: DataFrame, key: str = "fingerprint", pos: str = "pos") -> DataFrame:
    """The table after a batch.

    A known key keeps first_seen_at and its bookkeeping columns, all else comes from the batch's last row; a new key
    comes in with the first sighting of its first row, no failures, and else null bookkeeping. Rows of the table that the
    batch doesn't name stay.
    """
    new = latest(batch, key, pos).drop("sightings")
    old, fresh = table.alias("o"), new.alias("n")
    joined = old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    seen = F.col(f"n.{key}").isNotNull()

    def column(c: str) -> Column:
        if c == key:
            return F.coalesce(f"o.{key}", f"n.{key}")
        if c == "first_seen_at":
            return F.coalesce("o.first_seen_at", "n.first_seen_at")
        if c in DEFAULTS:
            return F.coalesce(F.col(f"o.{c}"), F.lit(DEFAULTS[c]).cast(table.schema[c].dataType))
        if c in BOOKKEEPING or c not in new.columns:
            return F.col(f"o.{c}")
        return F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(column(c).alias(c) for c in table.columns))


def upsert_results(table: DataFrame, batch: DataFrame, key: str = "fingerprint", pos: str = "pos") -> DataFrame:
    """(key, pos, outcome) of every row of the batch: new for the first sighting of an unknown key, else already_seen."""
    first = batch.groupBy(key).agg(F.min(pos).alias("first"))
    known = batch.join(table.select(F.col(key)).distinct().withColumn("known", F.lit(True)), key, "left").join(first, key)
    return known.select(key, pos, F.when(F.col("known").isNull() & (F.col(pos) == F.col("first")), "new").otherwise("already_seen").alias("outcome"))


def cache_upsert(table: DataFrame, batch: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The cache after a batch: for each composite key the batch's last row, else the old one."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in table.columns if c not in keys)), pos).alias("r")).select(*keys, "r.*")
    return table.join(last, keys, "left_anti").unionByName(last.select(*table.columns))


def is_active() -> Column:
    return F.col("duplicate_of").isNull()


def is_unnotified() -> Column:
    return is_active() & F.col("notified_at").isNull() & F.col("discarded_at").isNull()


def is_claimable(now: Column) -> Column:
    """Unnotified, and not claimed within the last hours."""
    return is_unnotified() & (F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.expr(f"INTERVAL {CLAIM_HOURS} HOURS")))


def claim(table: DataFrame, run: str, now: Column) -> DataFrame:
    """The table with all claimable rows claimed by a run."""
    free = is_claimable(now)
    return table.withColumns({"claimed_at": F.when(free, now).otherwise(F.col("claimed_at")), "claimed_by": F.when(free, F.lit(run)).otherwise(F.col("claimed_by"))})


def release(table: DataFrame, run: str) -> DataFrame:
    """The table without a run's claims on rows that it didn't notify of."""
    own = (F.col("claimed_by") == run) & F.col("notified_at").isNull()
    clear = lambda c: F.when(F.coalesce(own, F.lit(False)), F.lit(None)).otherwise(F.col(c))
    return table.withColumns({"claimed_at": clear("claimed_at"), "claimed_by": clear("claimed_by")})


def mark(table: DataFrame, ids: DataFrame, changes: dict[str, Column], key: str = "fingerprint", only: Column | None = None) -> DataFrame:
    """The table with columns changed on the rows that ids names (and where only holds)."""
    hit = ids.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    joined = table.join(hit, key, "left")
    where = F.col("__hit").isNotNull() if only is None else F.col("__hit").isNotNull() & F.coalesce(only, F.lit(False))
    return joined.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*table.columns)


def mark_notified(table: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return mark(table, ids, {"notified_at": now})


def discard(table: DataFrame, ids: DataFrame, reason: str | None, now: Column) -> DataFrame:
    """Discarding is written once: a later one changes nothing."""
    return mark(table, ids, {"discarded_at": now, "discard_reason": F.lit(reason)}, only=F.col("discarded_at").isNull())


def restore_duplicate(table: DataFrame, ids: DataFrame) -> DataFrame:
    return mark(table, ids, {"duplicate_of": F.lit(None).cast("string")})


def clear_duplicates(table: DataFrame) -> DataFrame:
    return table.withColumn("duplicate_of", F.lit(None).cast("string"))


def failures() -> Column:
    """Scoring failures in a row; rows older than the counter have none."""
    return F.coalesce(F.col("score_failures"), F.lit(0))


def record_score_failure(table: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more failure for each of the ids."""
    return mark(table, ids, {"score_failures": (failures() + 1).cast(table.schema["score_failures"].dataType), "last_score_failed_at": now})


def clear_score_failures(table: DataFrame, ids: DataFrame) -> DataFrame:
    """No failures any more, after a success."""
    return mark(table, ids, {"score_failures": F.lit(0).cast(table.schema["score_failures"].dataType), "last_score_failed_at": F.lit(None).cast("timestamp")})


def split_exhausted(candidates: DataFrame, most: int = MOST_FAILURES) -> tuple[DataFrame, DataFrame]:
    """(to score, exhausted): rows that have failed ``most`` times in a row are surfaced without another try."""
    over = failures() >= most
    return candidates.filter(~over), candidates.filter(over)


def rescore(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Free for another try, only where the last one failed: no failures, not notified of, and no claim left."""
    none = {c: F.lit(None).cast(table.schema[c].dataType) for c in ("last_score_failed_at", "notified_at", "claimed_at", "claimed_by") if c in table.columns}
    return mark(table, ids, {"score_failures": F.lit(0).cast(table.schema["score_failures"].dataType), **none}, only=failures() > 0)


def set_extracted(table: DataFrame, extracted: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Seniority and years of experience from an extraction, where it has any."""
    new = extracted.select(key, F.col("seniority").alias("__s"), F.col("experience_years").alias("__y"))
    return table.join(new, key, "left").withColumns({"seniority": F.coalesce("__s", "seniority"), "experience_years": F.coalesce("__y", "experience_years")}).select(*table.columns)


def add_columns(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Schema change: columns that the table lacks, with their default."""
    return table.withColumns({c: v for c, v in columns.items() if c not in table.columns})


def orphans_removed(child: DataFrame, parent: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of the child whose key the parent has."""
    return child.join(parent.select(key).distinct(), key, "left_semi")


def hydrated(rows: DataFrame) -> DataFrame:
    """Stored rows as postings: a known location needs a city, collected_at is the last sighting, broken payloads are marked."""
    known = (F.col("location_kind") == "known") & F.col("location_city").isNotNull()
    whole = F.try_parse_json("raw_payload").isNotNull()
    payload = F.when(F.col("raw_payload").isNull() | whole, F.col("raw_payload")).otherwise(F.lit('{"corrupted":true}'))
    return rows.withColumns({"__known": F.coalesce(known, F.lit(False)), "collected_at": F.col("last_seen_at"), "raw_payload": payload}).withColumns({"location_kind": F.when(F.col("__known"), "known").otherwise("unknown"), "location_city": F.when(F.col("__known"), F.col("location_city"))}).drop("__known")


class Snapshots:
    """Versions of a table under a folder, with a pointer to the current one; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n.removesuffix(".current") for n in names if n.endswith(".current"))

    def read(self) -> DataFrame | None:
        """The newest committed version."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.root}/{found[-1]}") if found else None

    def write(self, df: DataFrame, keep: int = 7) -> str:
        """Write a version, commit it by its marker file, and remove all but the newest ``keep``."""
        before = self.versions()
        name = f"v{int(before[-1][1:9]) + 1 if before else 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}")
        self._fs.create(self._path(f"{self.root}/{name}.current"), False).close()
        for old in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{old}.current"), False)
            self._fs.delete(self._path(f"{self.root}/{old}"), True)
        return name
