"""Command line: ``python -m folioscope --store … <command>``.

build   ingest the libraries of a name list into a store and index them (``--limit``, ``--force``)
ask     print the answers to one query
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import candidates, freshness, upsert
from .plans import libraries
from .plans.store import Store
from .sources import files, http


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    """Names with a curated entry are known at once; others must be in the store already."""
    store = Store(spark, args.store, args.buckets)
    names = files.name_list(spark, args.names).distinct()
    if args.limit:
        names = names.orderBy("name").limit(args.limit)
    known = candidates.curated(names.withColumn("query", F.lit("")), files.aliases(spark, args.aliases))
    incoming = known.select("id", "name", "repo", "docs_url", "trust", "latest_ver", F.array().cast("array<string>").alias("versions"))
    libs = store.read("libs")
    ids = names.select(paths.clean_id(F.col("name")).alias("id"))
    if args.force:
        touched = store.buckets_of(ids, "id")
        store.write_chunks(upsert.drop_libs(store.read("chunks", touched), ids), touched)
        store.write("crawl_state", upsert.drop_libs(store.read("crawl_state"), ids))
        libs = upsert.drop_libs(libs, ids, key="id")
    store.write("libs", upsert.merge_libs(libs, incoming))
    caps = ids.withColumn("cap", F.lit(0))
    store.write("libs", upsert.set_flags(store.read("libs"), caps))
    libraries.refresh_store(store, ids, http.fetch, max_age=freshness.MAX_AGE).groupBy("branch", "complete").count().show(truncate=False)
    if not store.index_is_current():
        store.build_index()


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    Store(spark, args.store, args.buckets).get_docs_one(args.library, args.query, args.version).show(truncate=120)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioscope")
    parser.add_argument("--store", required=True)
    parser.add_argument("--buckets", type=int, default=64)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("build")
    one.add_argument("--names", required=True)
    one.add_argument("--aliases", required=True)
    one.add_argument("--limit", type=int)
    one.add_argument("--force", action="store_true")
    one.set_defaults(run=build)
    two = commands.add_parser("ask")
    two.add_argument("library")
    two.add_argument("query")
    two.add_argument("--version", default="")
    two.set_defaults(run=ask)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("folioscope").getOrCreate(), args)


if __name__ == "__main__":
    main()
