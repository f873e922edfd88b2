"""Command line: run a registered query, plan a build, list a catalog, look into a cache and clear it, read a mark."""

from __future__ import annotations

import argparse

from tilequarry import spark as sessions


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tilequarry")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a registered query")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    commands.add_parser("queries", help="list the registered queries")
    for name, text in (("build", "plan a target's build"), ("list", "list a configuration")):
        own = commands.add_parser(name, help=text)
        own.add_argument("--config", required=True)
    commands.choices["build"].add_argument("--target", required=True)
    commands.choices["build"].add_argument("--cache", default=None)
    commands.choices["build"].add_argument("--bbox", type=float, nargs=4, metavar=("W", "S", "E", "N"))
    for name in ("lng", "lat", "width", "height"):
        commands.choices["build"].add_argument(f"--{name}", type=float)
    commands.choices["build"].add_argument("--zoom", help="zooms with commas between")
    cache = commands.add_parser("cache", help="what a cache holds by source, or remove it")
    cache.add_argument("action", choices=("status", "clean"))
    cache.add_argument("--cache", required=True)
    cache.add_argument("--source", help="clean this source only")
    cache.add_argument("--force", action="store_true", help="do not ask")
    mark = commands.add_parser("mark", help="print the readable header of a marked file")
    mark.add_argument("file")
    args = parser.parse_args(argv)
    if args.command == "queries":
        from tilequarry.plans import catalogue

        print("\n".join(sorted(catalogue.QUERIES)))
    elif args.command == "list":
        from tilequarry.plans import config

        for section, items in config.load(args.config).sections.items():
            print(f"{section}: {', '.join(sorted(items)) or '-'}")
    elif args.command == "cache":
        from tilequarry.sources import cache

        if args.action == "status":
            rows = cache.status(sessions.session(), args.cache)
            print("\n".join(f"{r['source'] or 'total'}: {r['tiles']} tiles, {r['human']}" for r in rows.orderBy(rows["source"].asc_nulls_last()).collect()))
        else:
            folders = cache.folders(args.cache, args.source)
            if not folders:
                print("nothing to clean")
            elif args.force or input(f"remove {', '.join(f.name for f in folders)}? [y/N] ").strip().lower() in ("y", "yes"):
                print("\n".join(f"removed {name}" for name in cache.clean(folders)))
            else:
                print("nothing removed")
    elif args.command == "mark":
        from tilequarry.operators import watermark

        rows = sessions.session().read.format("binaryFile").load(args.file).select(watermark.header_text("content").alias("header"))
        print(next((r["header"] for r in rows.collect() if r["header"] is not None), "no mark"))
    else:
        spark = sessions.session()
        if args.command == "run":
            from tilequarry.plans import catalogue

            catalogue.QUERIES[args.query](spark, args.folder).show(args.rows, truncate=False)
        else:
            from tilequarry.plans import build, config, extent
            from tilequarry.sources import files

            none = spark.createDataFrame([], "z int, x long, y long, path string, size long")
            cached = files.tile_cache(files.listing(spark, [args.cache])) if args.cache else none
            box = extent.extent(args.bbox, args.lng, args.lat, args.width, args.height)
            wanted = extent.narrowed(config.load(args.config), args.target, box, extent.zooms(args.zoom))
            plan = build.plan(spark, wanted, args.target, cached)
            plan.summary.orderBy("z").show()
            plan.groups.orderBy("z").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
