"""One replacement for each value, whenever it comes: a stored table of keyed hashes and replacements that runs share.

A value that a masking or generalising rule finds takes the replacement that it was first given, in this or an earlier run, though rules or their parameters
have changed. The store holds no values, only their keyed hashes. It grows by versions: a run writes the entries that are missing into a folder of its own and then puts a manifest that
names it, which fails where another run has put one first; then what that one has added is read, and what is still missing is put again. So the
first writer of a value wins, and a run that dies leaves a folder that no manifest names.

Nearly always the stored replacement is what the rule makes anyway. Only values where it isn't are joined back to their records.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.sources.resume import Manifest, newest, put_manifest

ENTRY = "hmac_key string, sanitized_value string"
#: Strategies whose replacements are stored; the others' depend on the value or the rule alone.
STORED = ("mask", "generalize")
#: How often a run tries to put its entries while others put theirs.
TRIES = 20


@dataclass(frozen=True)
class MappingStore:
    """The store in a folder that driver and executors share, with the key of its hashes."""

    folder: str
    key: str

    def entries(self, spark: SparkSession, at: Manifest | None = None) -> DataFrame:
        """hmac_key, sanitized_value of a version, the newest unless given."""
        names = (at or newest(spark, f"{self.folder}/versions")).files
        return spark.read.schema(ENTRY).parquet(*[f"{self.folder}/{name}" for name in sorted(names)]) if names else spark.createDataFrame([], ENTRY)

    def add(self, made: DataFrame) -> DataFrame:
        """The store's entries after those of made (hmac_key, sanitized_value; one for each key) that it lacks are put."""
        spark = made.sparkSession
        for _ in range(TRIES):
            known = newest(spark, f"{self.folder}/versions")
            missing = made.join(self.entries(spark, known), "hmac_key", "left_anti").select("hmac_key", "sanitized_value")
            name = f"entries-{uuid.uuid4().hex}"
            missing.write.parquet(f"{self.folder}/{name}")
            if spark.read.schema(ENTRY).parquet(f"{self.folder}/{name}").isEmpty():
                return self.entries(spark, known)
            after = Manifest(known.number + 1, {**known.files, name: {}})
            try:
                put_manifest(spark, f"{self.folder}/versions", after)
            except RuntimeError:  # another run was first
                continue
            return self.entries(spark, after)
        raise RuntimeError(f"{self.folder}: other runs put entries all the time")


def mapped_records(staged: DataFrame, store: MappingStore) -> DataFrame:
    """detected_records whose matches have the store's replacements. Of a value that is new and found with different ones, that of the first place (file, line, field) counts.
    staged is read several times, so it should be kept; a file's line numbers tell its records apart."""
    place = F.posexplode("_found").alias("_field", "_matches")
    hits = staged.select("source_file", "line_no", place).select("source_file", "line_no", "_field", F.explode("_matches").alias("m")).filter(F.col("m.strategy").isin(*STORED))
    hits = hits.select("source_file", "line_no", F.col("m.value").alias("value"), F.col("m.new").alias("new"), F.struct("source_file", "line_no", "_field", "m.start").alias("at"))
    forms = hits.groupBy("value", "new").agg(F.min("at").alias("at")).withColumn("hmac_key", S.hmac_sha256(F.col("value"), store.key))
    made = forms.groupBy("hmac_key").agg(F.min_by("new", "at").alias("sanitized_value"))
    other = forms.join(store.add(made), "hmac_key").filter("new <> sanitized_value").select("value", "new", "sanitized_value")
    if other.isEmpty():
        return staged
    maps = hits.join(other, ["value", "new"]).groupBy("source_file", "line_no").agg(F.map_from_entries(F.collect_set(F.struct("value", "sanitized_value"))).alias("_stored"))
    told = lambda m: F.when(m["strategy"].isin(*STORED), F.coalesce(F.element_at("_stored", m["value"]), m["new"])).otherwise(m["new"])
    changed = F.transform("_found", lambda found: F.transform(found, lambda m: m.withField("new", told(m))))
    return staged.join(maps, ["source_file", "line_no"], "left").withColumn("_found", F.when(F.col("_stored").isNull(), F.col("_found")).otherwise(changed)).drop("_stored")
