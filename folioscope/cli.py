"""Command line: consolidate, normalize, score, board."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns
from folioscope.operators import consolidate, postproc, report, score, validate
from folioscope.sources import parts, sinks


def _truth(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    key = "page_key" if "page_key" in df.columns else "page_id"
    return df.drop("image").withColumn("page_key", columns.page_key(F.col(key)))


def run_consolidate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, n = parts.read_parts(spark, a.parts)
    rows = consolidate.with_key(rows)
    sealed = consolidate.consolidate(rows)
    found = consolidate.counts(rows, sealed).first().asDict() | {"parts": n}
    if a.expect_rows is not None and found["rows"] != a.expect_rows:
        raise SystemExit(f"{found['rows']} rows instead of {a.expect_rows}")
    sealed.drop("row_ord").write.parquet(a.out)
    print(json.dumps(found))


def run_normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.rows)
    if a.model:
        rows = rows.withColumn("model", F.lit(a.model))
    postproc.normalize_frame(rows, identity_for_unregistered=a.identity_for_unregistered).write.parquet(a.out)


def run_score(spark: SparkSession, a: argparse.Namespace) -> None:
    truth = _truth(spark, a.truth)
    out = spark.read.parquet(a.outputs).withColumn("text", F.col(a.text)).withColumn("page_key", columns.page_key(F.col("page_id")))
    validate.check_join(out, truth)
    benchmark = score.benchmark_provenance(truth, a.truth, None, None)
    version = C.POSTPROC_VERSION if a.text == "markdown" else C.NO_POSTPROC
    rows = score.score_pages(score.join_outputs(out, truth), postproc_version=version).withColumn("benchmark_provenance", F.lit(columns.stable_json(benchmark)))
    absent = report.missing_pages(rows, truth).collect()
    if absent and not a.allow_missing:
        raise SystemExit("; ".join(f"{r['model']} lacks {r['missing']} pages, e.g. {', '.join(r['examples'])}" for r in absent))
    sinks.write_verified(sinks.flat_scorecards(rows), a.out)


def run_board(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = parts.union_globs(spark, a.scorecards)
    truth = _truth(spark, a.truth) if a.truth else None
    expected = None if truth is None else truth.select(F.col("page_key").alias("page_id"))
    validate.require(rows, require_complete=not a.allow_missing, expected=expected)
    provenance = {"report_schema": C.REPORT_SCHEMA_VERSION, "scorecard_schema": C.SCORECARD_SCHEMA_VERSION, "norm_version": C.NORM_VERSION, "scorer_version": C.SCORER_VERSION, "score": score.score_provenance(), "page_count": rows.select("page_id").distinct().count()}
    board = report.leaderboard(report.model_cards(rows, truth), provenance)
    report.write_leaderboard(board, a.out)
    print(report.format_board(board), end="")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("consolidate")
    c.add_argument("parts")
    c.add_argument("--expect-rows", type=int)
    n = sub.add_parser("normalize")
    n.add_argument("rows")
    n.add_argument("--model")
    n.add_argument("--identity-for-unregistered", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("--truth", required=True)
    s.add_argument("--outputs", required=True)
    s.add_argument("--text", default="markdown")
    s.add_argument("--allow-missing", action="store_true")
    b = sub.add_parser("board")
    b.add_argument("scorecards", nargs="+")
    b.add_argument("--truth")
    b.add_argument("--allow-missing", action="store_true")
    for x, f in ((c, run_consolidate), (n, run_normalize), (s, run_score), (b, run_board)):
        x.add_argument("--out", required=True)
        x.set_defaults(run=f)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("folioscope").getOrCreate(), a)


if __name__ == "__main__":
    main()
