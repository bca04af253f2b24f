"""Runs stages of the linkage run from a shell: ``python -m tessella clean block --folder DIR --split train``."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame

from tessella import session
from tessella.operators import reports
from tessella.plans import stages


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella", description=stages.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stage", nargs="+", choices=["convert", *stages.STAGES])
    parser.add_argument("--folder", required=True, help="of everything the run reads and writes")
    parser.add_argument("--split", default="train", choices=["train", "test"])
    parser.add_argument("--source", action="append", default=[], metavar="SPLIT:NUMBER:FILE", help="for convert")
    parser.add_argument("--truth", help="for convert")
    parser.add_argument("--master")
    asked = parser.parse_args(given)
    run = stages.Run(session.build(asked.master), asked.folder)
    for name in asked.stage:
        if name == "convert":
            parts = [s.split(":", 2) for s in asked.source]
            stages.convert(run, {(split, int(number)): path for split, number, path in parts}, asked.truth)
            continue
        stage = stages.STAGES[name]
        takes = inspect.signature(stage).parameters
        found = stage(run, asked.split) if "split" in takes else stage(run)
        if isinstance(found, DataFrame) and name in ("evaluate", "predict"):
            print(reports.markdown(found))


if __name__ == "__main__":
    main()
