"""Long lists of shell patterns and prefixes, given as rows, against many paths.

A path can match a pattern only if it has the pattern's literal parts. So each pattern is filed under one short piece of them,
paths meet patterns by an equi-join on their own pieces, and only what meets is matched. The first in its list that matches is
the answer, as in a loop over the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.session import settle

PIECE = 3
#: Of the paths, one in so many says which pieces are rare. It decides how much is matched, not what is found.
SAMPLE = 16
#: Rows of a list of patterns, some hundred bytes each, that are broadcast; longer lists are shuffled.
SHORT = 50_000


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of a size of a text, each once."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.when(size <= F.length(text), F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _met(rows: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(index) if index.count() <= SHORT else index, on)


@lru_cache(100_000)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex.removesuffix(r"\z") + r"\Z")


def first_glob(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """id, n, pattern: the first pattern of its list that a file's path matches; no row for a file without one.

    files: id, list, path; patterns: list, n (its place there), pattern, as in paths.glob_regex. Patterns without a literal
    meet every path of their list; those that differ in place only are one. Empty and null patterns and null paths match nothing.
    """
    once = patterns.filter("pattern <> ''").groupBy("list", "pattern").agg(F.min("n").alias("n"))
    runs = F.split(F.regexp_replace("pattern", r"(?s)\[!?+\]?+[^\]]*\]|[*?]", "\0"), "\0")
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    sized = once.withColumn("size", F.least(longest, F.lit(PIECE)))
    own = F.array_distinct(F.flatten(F.transform(runs, lambda r: _pieces(r, F.col("size")))))
    own = F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(own)
    filed = settle(sized.select("list", "n", "pattern", paths.glob_regex(F.col("pattern")).alias("regex"), F.col("size"), own.alias("pieces")), "patterns")
    sizes = sorted(r["size"] for r in filed.select("size").distinct().collect())  # at most 0 to PIECE

    def cut(some: DataFrame) -> DataFrame:
        each = [F.array(F.lit("")) if not s else _pieces(F.col("path"), F.lit(s)) for s in sizes]
        return some.filter("path is not null").select("id", "list", "path", F.explode(F.concat(*each) if each else F.array().cast("array<string>")).alias("piece"))

    keys = filed.select("list", "n", F.explode("pieces").alias("piece"))
    sample = files.filter(F.pmod(F.xxhash64("path"), F.lit(SAMPLE)) == 0)
    rarity = _met(cut(sample), keys.select("list", "piece").distinct(), ["list", "piece"]).groupBy("list", "piece").count()
    rarest = keys.join(rarity, ["list", "piece"], "left").groupBy("list", "n").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), -F.length("piece"), "piece"))["piece"].alias("piece")
    )
    index = settle(filed.select("list", "n", "pattern", "regex").join(rarest, ["list", "n"]), "pattern-index")
    met = _met(cut(files), index, ["list", "piece"]).select("id", "path", "n", "pattern", "regex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_compiled(regex).match(path) is not None for path, regex in zip(batch.column("path").to_pylist(), batch.column("regex").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["id", "n", "pattern"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    hits = met.mapInArrow(run, f"id {kinds['id']}, n {kinds['n']}, pattern string")
    return hits.groupBy("id").agg(F.min(F.struct("n", "pattern")).alias("first")).select("id", "first.n", "first.pattern")


def excluded(files: DataFrame, locations: DataFrame) -> DataFrame:
    """id, pattern: the first of its library's exclude patterns that a file's path below the library's root matches.

    files: id, storage_location_id, path; locations: id, path, exclude_globs, a pattern a line.
    """
    lists = locations.select(F.col("id").alias("list"), F.posexplode(paths.glob_list(F.col("exclude_globs"))).alias("n", "pattern"))
    roots = locations.filter("exclude_globs is not null").select(F.col("id").alias("storage_location_id"), F.col("path").alias("root"))
    own = files.select("id", "storage_location_id", "path").join(roots, "storage_location_id")
    rel = own.select("id", F.col("storage_location_id").alias("list"), paths.relative(F.col("path"), F.col("root")).alias("path"))
    return first_glob(rel, lists).select("id", "pattern")


def first_prefix(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id, name: the name of the first prefix that a file's path starts with, null without one.

    files: id, path; prefixes: n (its place in the list), prefix, name. A path is cut at the lengths that prefixes have, so it meets
    its own prefixes only. An empty prefix begins every path, a null one none.
    """
    once = prefixes.filter("prefix is not null").groupBy("prefix").agg(F.min(F.struct("n", "name")).alias("first"))
    index = settle(once.select("prefix", "first", F.length("prefix").alias("size")), "prefixes")
    sizes = [r["size"] for r in index.select("size").distinct().collect()]  # at most the longest prefix
    lengths = F.filter(F.lit(sizes).cast("array<int>"), lambda s: s <= F.length("path"))
    cut = files.select("id", F.explode_outer(F.transform(lengths, lambda s: F.substring("path", F.lit(1), s))).alias("prefix"))
    short = index.count() <= SHORT
    met = cut.join(F.broadcast(index.drop("size")) if short else index.drop("size"), "prefix", "left")
    return met.groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.name").alias("name"))
