"""Command line: ``run``, ``predict`` and ``status``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from pyspark.ml import PipelineModel

from textloom.plans import model
from textloom.plans.pipeline import Run, RunConfig
from textloom.session import local_session
from textloom.sources import artifacts
from textloom.sources.corpus import lines_frame
from textloom.types import Stage, TaskSpec

#: What may not change once a run has data.
FIXED = ("rule", "labeler", "corpus", "corpus_max_chars")
BATCH = 32


def merged(stored: dict | None, given: dict, has_data: bool) -> RunConfig:
    """Stored options overlaid by the given ones."""
    if stored and has_data:
        changed = [k for k in FIXED if k in given and given[k] != stored.get(k)]
        if changed:
            raise ValueError(f"cannot change {', '.join(changed)}: the run already has data")
    return RunConfig.from_dict({**(stored or {}), **given})


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="start or resume a run", argument_default=argparse.SUPPRESS)
    for f in dataclasses.fields(RunConfig):
        if f.name == "hparams":
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            run.add_argument(flag, action=argparse.BooleanOptionalAction)
        else:
            run.add_argument(flag, type={"int": int, "float": float}.get(f.type, str))
    run.add_argument("--stop-after", choices=[Stage.SPEC.value, Stage.PLAN.value, Stage.GENERATE.value], default=None)
    predict = commands.add_parser("predict", help="label texts with a run's best model")
    predict.add_argument("run", type=Path)
    predict.add_argument("texts", nargs="*")
    status = commands.add_parser("status", help="rounds of a run")
    status.add_argument("run", type=Path)
    return parser


def _run(options: dict) -> int:
    stop = options.pop("stop_after", None)
    root = Path(options.get("runs_dir", "runs")) / options["name"]
    stored = json.loads((root / "run.json").read_text())["config"] if (root / "run.json").exists() else None
    config = merged(stored, options, (root / "examples").exists())
    print(Run(local_session(), config).run(Stage(stop) if stop else None))
    return 0


def _predict(root: Path, texts: list[str]) -> int:
    spark = local_session()
    spec = TaskSpec.from_json((root / "spec.json").read_text())
    fitted = PipelineModel.load(str(root / "model"))

    def emit(lines: list[str]) -> None:
        rows = lines_frame(spark, lines).withColumnRenamed("seq", "id")
        for r in model.prediction_json(model.predict(spec, fitted, rows)).orderBy("id").collect():
            print(r["value"], flush=True)

    if texts:
        emit(texts)
        return 0
    size = 1 if sys.stdin.isatty() else BATCH
    waiting: list[str] = []
    for line in sys.stdin:
        waiting += [line] if line.strip() else []
        if len(waiting) >= size:
            emit(waiting)
            waiting = []
    if waiting:
        emit(waiting)
    return 0


def main(argv: list[str] | None = None) -> int:
    options = vars(_parser().parse_args(argv))
    command = options.pop("command")
    try:
        if command == "run":
            return _run(options)
        if command == "predict":
            return _predict(options["run"], options["texts"])
        print("\n".join(artifacts.status(artifacts.load_rounds(options["run"]))))
        return 0
    except (ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
