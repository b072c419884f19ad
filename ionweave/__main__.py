"""Command line: ``python -m ionweave library queries out [--config FILE] [--setting value ...]``.

A setting on the command line wins over the config file, which wins over the default.
"""

from __future__ import annotations

import argparse
import configparser
from dataclasses import fields
from pathlib import PurePath

from pyspark.sql import SparkSession

from ionweave.config import SearchConfig
from ionweave.plans.search import prepare, search
from ionweave.sources import mztab, registry, versions


def parse(args: list[str] | None = None) -> tuple[argparse.Namespace, SearchConfig]:
    """Paths and settings from a command line."""
    p = argparse.ArgumentParser("ionweave", description=__doc__.splitlines()[0])
    for name in ("library", "queries", "out"):
        p.add_argument(name)
    p.add_argument("--config", help="an INI file of settings")
    p.add_argument("--store", help="folder of the processed library and its index; beside the library if not given")
    for f in fields(SearchConfig):
        p.add_argument(f"--{f.name}", nargs="?", const="True")
    ns = p.parse_args(args)
    pairs: dict[str, str] = {}
    if ns.config:
        ini = configparser.ConfigParser()
        with open(ns.config, encoding="utf-8") as f:
            text = f.read()
        ini.read_string(text if text.lstrip().startswith("[") else f"[settings]\n{text}")
        for section in ini.sections():
            pairs |= dict(ini[section])
    pairs |= {f.name: v for f in fields(SearchConfig) if (v := getattr(ns, f.name)) is not None}
    try:
        return ns, SearchConfig.from_pairs(pairs)
    except (TypeError, ValueError) as e:
        p.error(str(e))


def run(spark: SparkSession, library: str, queries: str, out: str, cfg: SearchConfig, store: str | None = None) -> str:
    """Search a query file against a library file and write mzTab; returns the path written."""
    registry.verify(spark, library, registry.LIBRARY_READERS)
    lib = prepare(lambda: registry.read_library(spark, library, cfg), cfg, store or f"{library}.store", versions.source_mark(spark, library), spark)
    qry = registry.read_queries(spark, queries)
    about = qry.select(qry["id"].alias("query_id"), "retention_time", "source_index")
    found = search(qry, lib, cfg).join(about, "query_id")
    uri = lambda p: p if "://" in p else PurePath(p).as_posix()
    return mztab.write(found, out, cfg, uri(library), uri(queries))


def main(args: list[str] | None = None) -> int:
    ns, cfg = parse(args)
    spark = SparkSession.builder.appName("ionweave").getOrCreate()
    run(spark, ns.library, ns.queries, ns.out, cfg, ns.store)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
