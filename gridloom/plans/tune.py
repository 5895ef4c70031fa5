"""Sweeps of the detector's configuration, as a plan and as a command.

``python -m gridloom.plans.tune --images I --cells C --out O --set depth=3,5 --set val_frac=0.2,0.3`` fits every combination that has
no record in O yet, on the Parquet tables I (``image_id, hash``) and C (``image_id, cell, x, y``), and prints the report.
"""

from __future__ import annotations

import argparse
import dataclasses
import time
import typing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import sweep
from ..operators.boost import BoostConfig
from ..sources.config import Config, FrontConfig
from .detector import Detector

#: SQL types of the knobs' Python types.
KINDS = {int: "int", float: "double", bool: "boolean", str: "string"}


def knobs() -> dict[str, tuple[str, str, bool]]:
    """Section, SQL type and whether it may be missing, of each knob of both sections."""
    out = {}
    for section, kind in (("model", BoostConfig), ("train", FrontConfig)):
        hints = typing.get_type_hints(kind)
        for f in dataclasses.fields(kind):
            parts = typing.get_args(hints[f.name])
            if typing.get_origin(hints[f.name]) is tuple:
                out[f.name] = section, f"array<{KINDS[parts[0]]}>", False
            else:
                wanted = [p for p in parts if p is not type(None)] or [hints[f.name]]
                out[f.name] = section, KINDS[wanted[0] if len(wanted) == 1 else str], type(None) in parts
    return out


def configure(base: Config, overrides: dict[str, object]) -> Config:
    """``base`` with other values for some knobs; unknown knobs and invalid values are refused."""
    data, known = base.to_dict(), knobs()
    for name, value in overrides.items():
        if name not in known:
            raise ValueError(f"there is no knob {name!r}")
        if name == "thumb" and isinstance(value, str) and value.isdigit():
            value = int(value)
        data[known[name][0]][name] = value
    return Config.from_dict(data)


def tune(spark: SparkSession, images: DataFrame, cells: DataFrame, names: list[str], settings: dict[str, list[object]], out: str, base: Config | None = None, most: int | None = None, keep_scores: bool = False) -> DataFrame:
    """All records after fitting and measuring each configuration that has none. Models are kept as files below ``out``, scores where asked for."""

    def run(overrides: dict[str, object]) -> dict[str, float]:
        began = time.perf_counter()
        detector = Detector(configure(base or Config(), overrides), names).fit_images(images, cells)
        key = sweep.keyed(sweep.grid(spark, {k: [v] for k, v in overrides.items()})).first()["key"]
        detector.metadata["fit_seconds"] = time.perf_counter() - began
        detector.save(Path(out) / "models" / f"{key}.bin")
        if keep_scores:
            sweep.save_scores(detector.score_grid(cells), f"{out}/scores", key)
        return {m: v for m, v in detector.metadata.items() if m in sweep.METRICS}

    return sweep.run_sweep(spark, settings, run, f"{out}/records", most)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("images", "cells", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a configuration to start from, as JSON or YAML")
    parser.add_argument("--set", action="append", default=[], metavar="KNOB=VALUES")
    parser.add_argument("--most", type=int, help="runs at most")
    parser.add_argument("--keep-scores", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gridloom-tune").getOrCreate()
    known, settings = knobs(), {}
    for each in given.set:
        name, _, text = each.partition("=")
        if name not in known:
            parser.error(f"there is no knob {name!r}; there are {', '.join(sorted(known))}")
        _, kind, optional = known[name]
        settings[name] = sweep.knob_values(spark, text, kind, optional)
    images, cells = spark.read.parquet(given.images), spark.read.parquet(given.cells)
    width = len(cells.select("x").first()["x"])
    base = Config.load(given.config) if given.config else None
    found = tune(spark, images, cells, [f"x{k}" for k in range(width)], settings, given.out, base, given.most, given.keep_scores)
    print(sweep.report(found))


if __name__ == "__main__":
    main()
