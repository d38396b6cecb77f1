"""python -m rasterlark generate DIR | render DATA_DIR OUTPUT_DIR"""

from __future__ import annotations

import argparse

from rasterlark.plans.workflows import save_sample, visualize
from rasterlark.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="rasterlark")
    parser.add_argument("--master", help="Spark master, if spark-submit sets none")
    commands = parser.add_subparsers(dest="command", required=True)
    generate = commands.add_parser("generate", help="write the sample frame")
    generate.add_argument("directory", nargs="?", default="data/sample")
    render = commands.add_parser("render", help="draw every stored frame")
    render.add_argument("data", nargs="?", default="data/sample")
    render.add_argument("output", nargs="?", default="outputs/figures")
    arguments = parser.parse_args()

    spark = build_session(master=arguments.master)
    if arguments.command == "generate":
        save_sample(spark, arguments.directory)
        print(f"saved sample data to {arguments.directory}")
    else:
        count = visualize(spark, arguments.data, arguments.output)
        print(f"saved {count} pictures to {arguments.output}")


if __name__ == "__main__":
    main()
