"""Sinks: appended rows, reports, envelopes, a layout for point reads. Tables in versions are in `versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .security import etag


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def report(lines: DataFrame, path: str) -> None:
    """Lines of a report (section_ord, k, line) as one text file: header first, then the sections in order. A report is of one user, so one task writes it."""
    lines.orderBy("section_ord", "k").select("line").coalesce(1).write.mode("overwrite").text(path)


def envelope(signals: DataFrame, watchlist: DataFrame, generated_at: str) -> DataFrame:
    """One row: the response to one user as JSON: the signals of the assets in watchlist(asset) in order, how many these are, how many there are of all assets, and the sorted watch list. A watch list bounds what one response holds."""
    wanted = watchlist.select("asset").distinct()
    own = signals.join(wanted, "asset", "left_semi").agg(F.array_sort(F.collect_list(F.struct("asset", *(c for c in signals.columns if c != "asset")))).alias("signals"))
    total, names = signals.agg(F.count("*").alias("total_assets")), wanted.agg(F.array_sort(F.collect_list("asset")).alias("watchlist"))
    one = own.join(total).join(names)  # one row each
    return one.select(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.size("signals").alias("n_assets"), "total_assets", "watchlist", "signals")).alias("body"))


def sorted_layout(rows: DataFrame, path: str, key: str, ranges: int = 32, group_bytes: int = 1 << 20, distinct: int = 1 << 16) -> None:
    """Writes rows for point reads by key: ranges of keys in files of their own, sorted, in narrow row groups with bounds and Bloom filters, so a read by key opens the footers and reads one row group (and of it the pages around the key)."""
    placed = rows.repartitionByRange(ranges, key).sortWithinPartitions(key)
    options = {"parquet.block.size": group_bytes, "parquet.page.row.count.limit": 2000, f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": distinct}
    placed.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def conditional(bodies: DataFrame, held: str) -> DataFrame:
    """status, etag, body for each snapshot (generated_at, n_assets, body): 304 without a body where `held`, a column, is its tag already. The tag is of the time and the count, so an edit within a second changes it."""
    tag = etag(F.concat(F.col("generated_at"), F.col("n_assets").cast("string")))
    tagged = bodies.withColumn("etag", tag)
    same = F.coalesce(F.col("etag") == F.col(held), F.lit(False))
    return tagged.withColumn("status", F.when(same, 304).otherwise(200)).withColumn("body", F.when(~same, F.col("body")))
