"""Command line: recommendations of one user, or a description of the data, as text or JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from segrec.operators.facts import Star
from segrec.plans.serving import Unservable, q6, recommend


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="segrec", description=__doc__)
    parser.add_argument("tables", help="folder of the tables")
    parser.add_argument("--user", type=int)
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--category")
    parser.add_argument("--level", type=int, choices=(0, 1, 2))
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--describe", action="store_true")
    asked = parser.parse_args(args)
    star = Star(spark or SparkSession.builder.appName("segrec").getOrCreate(), asked.tables)
    if asked.describe:
        print(json.dumps(q6(star).first().asDict()))
        return 0
    if asked.user is None:
        parser.error("--user is needed")
    try:
        rows = recommend(star, asked.user, asked.k, asked.category, asked.level).orderBy("rank").select("rank", "item", "score", "tier", "explanation").collect()
    except Unservable as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    for r in rows:
        print(json.dumps(r.asDict()) if asked.json else f"{r['rank']:>3}  {r['item']:<16} {r['explanation']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
