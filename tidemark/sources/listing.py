"""Source listings (C-01) and source configs (C-09, C-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.mime import is_video_like
from tidemark.operators.ranking import group_rank, stored

PAGE_SCHEMA = ("pageToken STRING, files ARRAY<STRUCT<id: STRING, name: STRING, mimeType: STRING, md5Checksum: STRING, "
               "size: STRING, trashed: BOOLEAN>>, nextPageToken STRING")
PAGE_SIZE = 200
MAX_NAME = 128
MAX_PREFIX = 512


def read_pages(spark: SparkSession, path: str, source_name: str | None = None) -> DataFrame:
    """``source_name, token, next, files``: one row per page, named by the token it was asked for
    ('' for the first). Of several answers to one token one is taken, by the hash of its content."""
    pages = spark.read.schema(PAGE_SCHEMA + ("" if source_name is not None else ", source_name STRING")).json(path)
    src = F.lit(source_name) if source_name is not None else F.col("source_name")
    pages = pages.select(src.alias("source_name"), F.coalesce("pageToken", F.lit("")).alias("token"),
                         F.nullif(F.col("nextPageToken"), F.lit("")).alias("next"), "files")
    answer = F.struct("next", "files")
    best = pages.groupBy("source_name", "token").agg(F.max_by(answer, F.xxhash64(F.to_json(answer))).alias("_a"))
    return best.select("source_name", "token", "_a.next", "_a.files")


def listing_chain(pages: DataFrame) -> DataFrame:
    """``source_name, token, next, position, issue`` of every page: pages may lie in any files and order.

    List ranking by pointer doubling: in round k every page knows the page 2^k ahead, so pages up
    to 2^(k+1) from the first are found and a listing of n pages takes about log2(n) rounds. The
    listing ends at the first page without a next token. ``issue`` is ``unreached`` (position
    null: no chain from the first page leads there), ``dangling`` (the next page is missing),
    ``cycle`` (the next page came before) or null.
    """
    key = ["source_name", "token"]
    nodes = stored(pages.select(*key, "next"), "pages")
    ahead = nodes.join(nodes.select("source_name", F.col("token").alias("next")), ["source_name", "next"]).select(
        *key, F.col("next").alias("to"))
    reached = stored(nodes.where(F.col("token") == "").select(*key, F.lit(0).cast("long").alias("position")), "reached")
    known, step = reached.count(), 1
    while known:
        ahead = stored(ahead, "ahead")
        more = reached.join(ahead, key).select("source_name", F.col("to").alias("token"), (F.col("position") + step).alias("position"))
        reached = stored(reached.unionByName(more).groupBy(*key).agg(F.min("position").alias("position")), "reached")
        before, known = known, reached.count()
        if known == before:
            break
        then = ahead.select("source_name", F.col("token").alias("to"), F.col("to").alias("_to"))
        ahead = ahead.join(then, ["source_name", "to"]).select(*key, F.col("_to").alias("to"))
        step *= 2
    placed = nodes.join(reached, key, "left")
    # Every page is listed with the place of its next one, if there is such a page.
    after = nodes.select("source_name", "token").join(reached, key, "left").select(
        "source_name", F.col("token").alias("next"), F.col("position").alias("_after"), F.lit(True).alias("_there"))
    issue = (F.when(F.col("position").isNull(), "unreached")
             .when(F.col("next").isNotNull() & F.col("_there").isNull(), "dangling")
             .when(F.col("_after") <= F.col("position"), "cycle"))
    return placed.join(after, ["source_name", "next"], "left").select(*key, "next", "position", issue.alias("issue"))


def scan_listing_pages(spark: SparkSession, path: str, source_name: str | None = None) -> DataFrame:
    """C-01: paged listing JSON (``pageToken``, ``files[]``, ``nextPageToken``) to one row per file of
    the pages from the first to the last, keeping only video-like files that are not trashed. The
    source comes from ``source_name`` or a ``source_name=`` folder; pages off the chain (left over
    from another listing, say) do not count, ``listing_chain`` names them."""
    pages = read_pages(spark, path, source_name)
    chain = listing_chain(pages).where(F.col("position").isNotNull()).select("source_name", "token")
    rows = pages.join(chain, ["source_name", "token"], "left_semi").select("source_name", F.explode("files").alias("f"))
    out = rows.select(
        "source_name", F.col("f.id").alias("file_id"), F.col("f.name").alias("file_name"),
        F.col("f.mimeType").alias("mime_type"), F.col("f.md5Checksum").alias("md5"),
        F.col("f.size").try_cast("bigint").alias("size"), F.coalesce("f.trashed", F.lit(False)).alias("_trashed"))
    out = out.where(~F.col("_trashed")).drop("_trashed")
    return out.where(is_video_like("mime_type", "file_name"))


def write_listing_pages(listing: DataFrame, path: str, page_size: int = PAGE_SIZE, first_token: str | None = None,
                        mode: str = "overwrite") -> None:
    """Write a listing as chained JSON pages of at most ``page_size`` files per source, in files of
    mixed pages (a page is a bounded group, so collecting its entries into one row is bounded).
    ``first_token`` names the first page of a chain that does not start the listing."""
    if "doc_id" in listing.columns:
        page = F.floor(F.col("doc_id") / page_size)
    else:  # as many pages as the listing needs, so a page stays about as large as asked for
        page = F.pmod(F.xxhash64("file_id"), F.lit(max(1, -(-listing.count() // page_size))))
    paged = listing.withColumn("_page", page)
    pages = paged.groupBy("source_name", "_page").agg(F.collect_list(F.struct(
        F.col("file_id").alias("id"), F.col("file_name").alias("name"), F.col("mime_type").alias("mimeType"),
        F.col("md5").alias("md5Checksum"), F.col("size").cast("string").alias("size"),
        (F.col("trashed") if "trashed" in listing.columns else F.lit(False)).alias("trashed"))).alias("files"))
    # Pages are numbered without a window over a source: a hot source has very many.
    numbered = group_rank(pages, ["source_name"], ["_page"], "_n", count_col="_of")
    stem = first_token or "t"
    token = F.when(F.col("_n") > 1, F.concat(F.lit(f"{stem}-"), F.col("_n").cast("string"))).otherwise(F.lit(first_token))
    after = F.when(F.col("_n") < F.col("_of"), F.concat(F.lit(f"{stem}-"), (F.col("_n") + 1).cast("string")))
    (numbered.select("source_name", F.to_json(F.struct(
        token.cast("string").alias("pageToken"), "files", after.alias("nextPageToken"))).alias("value"))
     .repartition(F.xxhash64("value")).write.mode(mode).partitionBy("source_name").text(path))


def source_config(config: DataFrame) -> DataFrame:
    """C-09: each source definition with its rule violations (name 1..128 characters, folder
    id not empty, prefix at most 512 characters) and ``valid``."""
    name, folder, prefix = F.col("source_name"), F.col("folder_id"), F.col("object_prefix")
    violations = F.array_compact(F.array(
        F.when(name.isNull() | (F.length(name) < 1) | (F.length(name) > MAX_NAME), F.lit("name_length")),
        F.when(folder.isNull() | (F.length(folder) < 1), F.lit("folder_id_empty")),
        F.when(prefix.isNotNull() & (F.length(prefix) > MAX_PREFIX), F.lit("prefix_length"))))
    return config.withColumn("violations", violations).withColumn("valid", F.size("violations") == 0)


def unknown_source(requests: DataFrame, config: DataFrame) -> DataFrame:
    """C-10: requested source names absent from the config."""
    return requests.select("source_name").distinct().join(config.select("source_name"), "source_name", "left_anti")
