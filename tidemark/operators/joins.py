"""Set-wise joins between listing, catalog, inventory and config (J-01..J-07, J-09).

The reference answers these with per-row lookups or driver-side dictionaries; here each is
one equi join that Spark plans (shuffled hash / sort-merge, or broadcast when AQE sees a
small side at run time). All keys are near-unique, so a hot source does not make a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.checksums import meta_checksum

FILE_KEY = ["source_name", "file_id"]


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def join_listing_catalog(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """J-01: every listed file with its catalog row (``c_*`` columns, NULL when absent)."""
    c = _prefixed(catalog, "c_", FILE_KEY).withColumn("c_present", F.lit(True))
    return listing.join(c, FILE_KEY, "left")


def join_catalog_inventory(catalog: DataFrame, inventory: DataFrame, key_col: str = "object_key") -> DataFrame:
    """J-02: catalog rows with the object stored under their key (``o_*`` columns)."""
    o = inventory_view(inventory)
    return catalog.join(o, F.col(key_col) == F.col("o_key"), "left")


def inventory_view(inventory: DataFrame, with_checksum: bool = True) -> DataFrame:
    cols = [F.col("object_key").alias("o_key"), F.col("object_size").alias("o_size")]
    if with_checksum and "metadata" in inventory.columns:
        cols.append(meta_checksum("metadata").alias("o_checksum"))
    elif with_checksum:
        cols.append(F.lit(None).cast("string").alias("o_checksum"))
    return inventory.select(*cols)


#: Parts into which the rows of one source are dealt where they meet its one config row.
SALTS = 16


def salt(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salted(small: DataFrame) -> DataFrame:
    """``small`` once per salt: a hot source is then ``SALTS`` keys, whatever join Spark picks."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def with_config(df: DataFrame, config: DataFrame | None) -> DataFrame:
    """J-09: attach ``object_prefix`` of each file's source (NULL when not configured)."""
    if config is None:
        return df.withColumn("object_prefix", F.lit(None).cast("string"))
    cfg = config.select("source_name", F.col("object_prefix").cast("string").alias("object_prefix"))
    return (df.withColumn("_salt", salt(*FILE_KEY)).join(salted(cfg), ["source_name", "_salt"], "left")
            .drop("_salt"))


def join_plan_inputs(listing: DataFrame, catalog: DataFrame, inventory: DataFrame,
                     config: DataFrame | None, canonical_key) -> DataFrame:
    """J-03: listing left catalog on the file key, then left inventory on the canonical key.

    ``canonical_key`` is a function of the joined row (Column builder) because the key is
    built from the listing's name, not read from the catalog.
    """
    j = with_config(join_listing_catalog(listing, catalog), config)
    j = j.withColumn("canonical_key", canonical_key(j))
    return j.join(inventory_view(inventory), F.col("canonical_key") == F.col("o_key"), "left")


def not_in_catalog(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """J-05: listed files without a catalog row."""
    return listing.join(catalog.select(*FILE_KEY), FILE_KEY, "left_anti")


def fetch_metadata(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """C-11: the listing rows of the wanted ``(source_name, file_id)`` keys."""
    return listing.join(wanted.select(*FILE_KEY), FILE_KEY, "left_semi")


def point_lookup(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """C-05: one row per wanted key: ``n_rows`` found and the catalog's columns. The columns are
    NULL unless exactly one row was found, so a key held twice shows as an error (``n_rows`` > 1)."""
    rest = [c for c in catalog.columns if c not in FILE_KEY]
    wanted = keys.select(*FILE_KEY).distinct()
    found = (catalog.join(wanted, FILE_KEY, "left_semi").groupBy(*FILE_KEY)
             .agg(F.count(F.lit(1)).alias("n_rows"), F.first(F.struct(*rest)).alias("_row")))
    out = wanted.join(found, FILE_KEY, "left")
    one = F.when(F.col("n_rows") == 1, F.col("_row"))
    return out.select(*FILE_KEY, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      *[one[c].alias(c) for c in rest])


def stat_objects(keys: DataFrame, inventory: DataFrame, key_col: str = "object_key") -> DataFrame:
    """C-03: size and metadata of wanted keys; a missing key gives NULLs."""
    inv = inventory.select(F.col("object_key").alias("_k"), "object_size",
                           *(["metadata"] if "metadata" in inventory.columns else []))
    return keys.join(inv, F.col(key_col) == F.col("_k"), "left").drop("_k")
