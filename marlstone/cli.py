"""Command line: inspect-config, index, ask, evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import answer
from .plans import policy as P
from .session import ship
from .sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("command", choices=("inspect-config", "index", "ask", "evaluate"))
    p.add_argument("--profile", required=True)
    p.add_argument("--source")
    p.add_argument("--store")
    p.add_argument("--query")
    p.add_argument("--dataset")
    a = p.parse_args(argv)
    profile = files.load_profile(a.profile)
    uri = a.source or profile["source"]["uri"]
    if a.command == "inspect-config":
        print(files.report_json({"profile": profile, "manifest": P.manifest(uri, profile), "capabilities": P.capabilities()}))
        return 0
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    ship(spark)
    if a.command == "index":
        if not a.store:
            p.error("index needs --store")
        print(files.report_json({"chunks": answer.index(spark, profile, a.store, uri)}))
        return 0
    chunks = answer.Store(spark, a.store).rows(P.manifest(uri, profile)) if a.store else answer.chunks_of(spark, profile, uri)
    if a.command == "ask":
        if not a.query:
            p.error("ask needs --query")
        said, found = answer.ask(chunks, spark.createDataFrame([(0, a.query)], "query_id long, query string"), profile)
        r = said.first()
        cites = [{"rank": f.rank, "uri": f.uri, "chunk_id": f.chunk_id} for f in found.orderBy("rank").collect()]
        print(files.report_json({"answer": r.answer, "citation": r.citation, "retrieved": cites}))
        return 0
    if not a.dataset:
        p.error("evaluate needs --dataset")
    print(files.report_json({r.metric: r.value for r in answer.evaluate(chunks, files.read_examples(spark, a.dataset), profile).collect()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
