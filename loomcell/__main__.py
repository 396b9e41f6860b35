"""python -m loomcell index | count: see --help of each."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from loomcell.plans import workflow


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomcell")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build the reference tables")
    i.add_argument("-g", "--genome", required=True)
    i.add_argument("-t", "--gtf", required=True)
    i.add_argument("-o", "--out", default=".")
    i.add_argument("-p", "--prefix", default="loomcell")
    i.add_argument("-k", type=int, default=29)
    i.add_argument("--no-bwt", action="store_true", help="taken for compatibility: the genome's postings are always made")
    c = sub.add_parser("count", help="count molecules of genes in cells")
    c.add_argument("-x", "--index", required=True)
    c.add_argument("-o", "--out", default=".")
    c.add_argument("-p", "--prefix", default="loomcell")
    c.add_argument("-1", dest="r1", nargs="+", required=True)
    c.add_argument("-2", dest="r2", nargs="+", required=True)
    c.add_argument("-l", "--library", type=int, default=0)
    c.add_argument("-k", type=int, default=29)
    c.add_argument("-t", "--threads", type=int, help="local threads, where no cluster is configured")
    c.add_argument("--temp-dir", help="Spark's local folder")
    c.add_argument("--log", help="a file to which the read statistics are appended")
    c.add_argument("--dump-align", action="store_true")
    c.add_argument("--count-intron", action="store_true")
    c.add_argument("--introns", action="store_true", help="tell reads inside genes from other genome reads")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("loomcell")
    if getattr(a, "threads", None) and "MASTER" not in os.environ:
        builder = builder.master(f"local[{a.threads}]")
    if getattr(a, "temp_dir", None):
        builder = builder.config("spark.local.dir", a.temp_dir)
    spark = builder.getOrCreate()
    if a.command == "index":
        workflow.index(spark, a.genome, a.gtf, a.out, a.prefix, a.k)
    else:
        done = workflow.count(spark, a.index, a.r1, a.r2, a.out, a.prefix, a.library, a.k, a.dump_align, a.count_intron, a.introns)
        found = workflow.log_summary(done, a.log) if a.log else done.statistics
        print(", ".join(f"{k} {v}" for k, v in found.first().asDict().items()))


if __name__ == "__main__":
    main()
