"""The commands: `python -m sieveline COMMAND --data FOLDER [--limit N] [--out FOLDER]` runs a query over a folder of tables."""

from __future__ import annotations

import argparse

from .plans import catalog_queries, checking_queries, curation_queries, further_queries, ingest_queries, placing_queries, registry, release_queries, routing_queries  # noqa: F401  (all register)

#: What a command does, by the query that answers it.
COMMANDS = {
    "search": "catalog_search", "similar": "vector_topk_allowed", "find": "text_search_sorted", "scan": "known_changes", "import": "bulk_import", "analyze": "derived_features", "status": "coverage_status",
    "resolve": "home_votes", "dedup": "dup_keeper_rank", "near-dups": "near_dup_keepers", "audit": "coverage_audit", "db-stats": "category_stats", "build": "build_by_category", "dry-run": "dry_run",
    "why": "explain_item", "left-out": "exclusion_sentences", "diff": "change_log", "verify": "verify_manifest", "verify-ratings": "verify_ratings", "render-check": "render_violations", "releases": "release_list",
    "publish-plan": "release_plan", "device-plan": "device_plan", "sync": "incremental_sync", "queue": "review_queue", "misfiles": "misfile_margin", "ratings": "ratings_after", "score": "scorecard",
    "report": "report_rows", "train": "sound_model", "key": "key_estimate", "events": "gap_sessions", "missing": "missing_marks", "moves": "lock_moves", "demo": "synthetic_items",
}


def answer(spark, command: str, folder: str):
    """The DataFrame of a command over a folder of tables."""
    return registry.QUERIES[COMMANDS[command]](spark, folder)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--data", required=True, help="folder of the tables, in any store that Spark reads")
    parser.add_argument("--limit", type=int, default=20, help="rows to print")
    parser.add_argument("--out", help="write the whole result there as Parquet instead of printing rows")
    said = parser.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    found = answer(spark, said.command, said.data)
    if said.out:
        found.write.parquet(said.out)
    else:
        found.show(said.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
