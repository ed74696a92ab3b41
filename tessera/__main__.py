"""`python -m tessera list` and `python -m tessera run NAME --tables DIR [--out DIR]`."""

import argparse

from tessera.plans import all_plans
from tessera.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("--tables", required=True)
    run.add_argument("--out")
    args = parser.parse_args(argv)
    plans = all_plans()
    if args.command == "list":
        print("\n".join(sorted(plans)))
        return 0
    if args.name not in plans:
        parser.error(f"unknown query: {args.name}")
    df = plans[args.name][0](session(), args.tables)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
