"""python -m vecloom ROOT COMMAND ...: register, refresh, set, status, info, search and drop indexes under a root folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.search import search
from .plans import admin
from .plans.catalog import Catalog, register, set_options, unregister
from .plans.refresh import refresh


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("register")
    for name in ("name", "source", "id", "vec"):
        r.add_argument(name)
    r.add_argument("--op")
    r.add_argument("--ver")
    r.add_argument("--metric", default="l2")
    r.add_argument("--margin", type=int)
    r.add_argument("--type", default="hnsw")
    f = sub.add_parser("refresh")
    f.add_argument("name")
    f.add_argument("--mode")
    o = sub.add_parser("set")
    o.add_argument("name")
    o.add_argument("options", nargs="+", help="option=value")
    for name in ("status", "drop"):
        sub.add_parser(name).add_argument("name")
    sub.add_parser("info")
    s = sub.add_parser("search")
    s.add_argument("name")
    s.add_argument("query", help="'[x1, x2, ...]'")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--precision")
    s.add_argument("--freshness")
    s.add_argument("--radius", type=float)
    return p


def value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    c = Catalog(spark or SparkSession.builder.appName("vecloom").getOrCreate(), a.root)
    if a.command == "register":
        print(register(c, a.name, a.source, a.id, a.vec, a.op, a.ver, a.metric, a.margin, a.type))
    elif a.command == "refresh":
        print(refresh(c, a.name, a.mode))
    elif a.command == "set":
        print(set_options(c, a.name, **{k: value(v) for k, v in (x.split("=", 1) for x in a.options)}))
    elif a.command == "drop":
        unregister(c, a.name)
    elif a.command == "status":
        for r in admin.status(c, a.name).collect():
            print(f"{r.level}: {r.message}")
    elif a.command == "info":
        admin.info(c).show(truncate=False)
    else:
        search(c, a.name, query=a.query, k=a.k, precision=a.precision, freshness=a.freshness, radius=a.radius).show(a.k, truncate=False)


if __name__ == "__main__":
    main()
