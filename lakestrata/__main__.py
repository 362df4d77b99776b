"""Run one layer's workflow file: ``python -m lakestrata LAYER WORKFLOW --root ROOT``."""

from __future__ import annotations

import argparse

from lakestrata.layout import Layout
from lakestrata.plans import config
from lakestrata.plans.lakehouse import Lakehouse
from lakestrata.session import get_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lakestrata", description=__doc__)
    parser.add_argument("layer", choices=["bronze", "silver", "gold"])
    parser.add_argument("workflow", help="JSON list of entries")
    parser.add_argument("--root", default="", help="folder that holds all layers")
    parser.add_argument("--pattern", default=Layout.pattern, help="path of a table")
    parser.add_argument("--sql-dir", help="folder of the SQL files (default: the workflow's)")
    options = parser.parse_args(arguments)

    spark = get_session(f"lakestrata-{options.layer}")
    house = Lakehouse(spark, Layout(options.root, options.pattern))
    sql_dir = options.sql_dir or options.workflow.rpartition("/")[0] or "."
    if options.layer == "bronze":
        house.run_bronze(config.load(spark, options.workflow, config.BronzeEntry))
    elif options.layer == "silver":
        house.run_silver(config.load(spark, options.workflow, config.SilverEntry), sql_dir)
    else:
        house.run_gold(config.load(spark, options.workflow, config.GoldEntry), sql_dir)


if __name__ == "__main__":
    main()
