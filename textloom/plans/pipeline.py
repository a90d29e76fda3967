"""The round loop: spec, plan, data, training, evaluation, verdict; every stage's artifact makes it resumable."""

from __future__ import annotations

import dataclasses
import logging
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text
from textloom.operators import labelers, quotas, sampling, scan
from textloom.operators.metrics import MAX_ERRORS
from textloom.operators.pools import split_train_valid
from textloom.operators.verify import gate
from textloom.plans import generation, model
from textloom.plans.providers import Provider, ProviderError, Researcher, parse_spec, provider
from textloom.session import ensure_checkpoint_dir
from textloom.sources import artifacts
from textloom.sources.corpus import CorpusError, corpus_format, stored_passages
from textloom.sources.store import ExampleStore
from textloom.types import (
    EXAMPLE, Agreement, DataPlan, Decision, HParamPatch, Metrics, Pool, Record, RoundResult, Split, Stage, TaskSpec,
    TrainConfig, Verdict,
)

log = logging.getLogger(__name__)

#: Stored texts of which prompts may quote some.
SHOWN = 1000
TOP_UP_SHARE, TOP_UP_FACTOR = 0.05, 1.5
_RANGES = {"corpus_max_chars": 20, "examples": 2, "test_examples": 1, "examples_per_round": 1, "max_rounds": 1, "workers": 1}


@dataclass(frozen=True)
class RunConfig(Record):
    """All that starts or resumes a run."""

    name: str
    rule: str
    runs_dir: str = "runs"
    model: str = "base"
    llm: str = "local:model@http://localhost:8000/v1"
    eval_llm: str | None = None
    planner_llm: str | None = None
    web: bool = False
    verify: bool = True
    warm_start: bool = True
    labeler: str | None = None
    corpus: str | None = None
    corpus_max_chars: int = 300
    examples: int = 400
    test_examples: int = 200
    examples_per_round: int = 200
    max_rounds: int = 3
    target: float = 0.9
    valid_ratio: float = 0.15
    workers: int = 4
    seed: int = 42
    hparams: HParamPatch = field(default_factory=HParamPatch)

    def __post_init__(self) -> None:
        if not isinstance(self.hparams, HParamPatch):
            object.__setattr__(self, "hparams", HParamPatch.from_dict(self.hparams))
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", self.name):
            raise ValueError(f"bad run name {self.name!r}")
        if not self.rule:
            raise ValueError("a run needs a rule")
        for name, least in _RANGES.items():
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.target <= 0 or not 0 < self.valid_ratio < 1:
            raise ValueError("target must be positive and valid_ratio between 0 and 1")
        model.base_model(self.model, "en")
        for text in (self.llm, self.eval_llm, self.planner_llm):
            if text is not None:
                parse_spec(text)
        if self.labeler is not None:
            labelers.parse_reference(self.labeler)
        if self.corpus is not None:
            corpus_format(self.corpus)
            if self.labeler is None:
                raise ValueError("a corpus needs a labeler")

    @property
    def root(self) -> Path:
        return Path(self.runs_dir) / self.name


@dataclass(frozen=True)
class RunState(Record):
    config: dict[str, Any]
    round: int = 0
    agreement: dict[str, dict[str, int]] = field(default_factory=dict)


@dataclass(frozen=True)
class RoundInit(Record):
    warm_from: int | None = None


class Roles:
    """Providers of a run, each made when first needed."""

    def __init__(self, config: RunConfig, factory: Callable[[str], Provider]) -> None:
        self.config, self.factory = config, factory

    @cached_property
    def generator(self) -> Provider:
        return self.factory(self.config.llm)

    @cached_property
    def evaluator(self) -> Provider:
        return self.factory(self.config.eval_llm) if self.config.eval_llm else self.generator

    @cached_property
    def planner(self) -> Provider:
        return self.factory(self.config.planner_llm) if self.config.planner_llm else self.generator

    @property
    def researcher(self) -> Researcher | None:
        if not self.config.web or not isinstance(self.planner, Researcher):
            return None
        return self.planner


class Run:
    """One run over a Spark session."""

    def __init__(self, spark: SparkSession, config: RunConfig, factory: Callable[[str], Provider] = provider) -> None:
        self.spark, self.config, self.roles = spark, config, Roles(config, factory)
        self.root = config.root
        self.store = ExampleStore(spark, str(self.root / "examples"))
        ensure_checkpoint_dir(spark)

    def run(self, stop_after: Stage | None = None) -> Path:
        """Run or resume; the best model's folder, or the artifact of the stage to stop after."""
        config, root = self.config, self.root
        self._state(0)
        if config.corpus is not None and not Path(config.corpus).is_file():
            raise CorpusError(f"corpus file not found: {config.corpus}")
        spec = artifacts.cached(root / "spec.json", TaskSpec, lambda: generation.define_spec(config.rule, self.roles.planner))
        base = model.base_model(config.model, spec.language)
        if stop_after is Stage.SPEC:
            return root / "spec.json"
        labeler = labelers.load(config.labeler, spec) if config.labeler else None
        plan = artifacts.cached(
            root / "plan.json", DataPlan, lambda: generation.make_plan(self.spark, spec, self.roles.planner, self.roles.researcher)
        )
        if stop_after is Stage.PLAN:
            return root / "plan.json"
        self._first_data(spec, plan, labeler)
        self._state(0)
        if stop_after is Stage.GENERATE:
            return root / "examples"
        current = config.hparams.apply(TrainConfig(base, seed=config.seed))
        for n in range(config.max_rounds):
            self._state(n)
            used, verdict = self._round(n, spec, plan, current)
            if verdict.decision in (Decision.ACCEPT, Decision.STOP) or n + 1 >= config.max_rounds:
                break
            if verdict.decision is Decision.MORE_DATA:
                self._more_data(spec, plan, labeler, n + 1, verdict.focus)
                self._state(n)
            current = verdict.hparams.apply(used)
            if current == used and self.store.load(Split.TRAIN, n + 1).isEmpty():
                log.warning("round %d would repeat round %d", n + 1, n)
                break
        return root / "model"

    def _round(self, n: int, spec: TaskSpec, plan: DataPlan, current: TrainConfig) -> tuple[TrainConfig, Verdict]:
        config, folder = self.config, self.root / "rounds" / str(n)
        used = artifacts.cached(folder / "train_config.json", TrainConfig, lambda: current)
        warm = n - 1 if config.warm_start and n > 0 else None
        warm = artifacts.cached(folder / "init.json", RoundInit, lambda: RoundInit(warm)).warm_from
        if not (folder / "model").exists():
            folder.mkdir(parents=True, exist_ok=True)
            start = None if warm is None else PipelineModel.load(str(self.root / "rounds" / str(warm) / "model"))
            valid = self.store.load(Split.VALID)
            model.save(model.train(spec, self.store.load(Split.TRAIN), used, start, valid), folder / "model")
        fitted = PipelineModel.load(str(folder / "model"))

        def scored(split: Split) -> Metrics:
            return model.evaluate(spec, fitted, self.store.load(split).select("id", "text", "labels", "spans"))

        metrics = artifacts.cached(folder / "metrics.json", Metrics, lambda: scored(Split.TEST))
        valid = artifacts.cached(folder / "valid_metrics.json", Metrics, lambda: scored(Split.VALID))
        history = artifacts.load_rounds(self.root)
        artifacts.link_best(self.root, history)
        # the judge sees test scores but validation errors: test texts never reach a prompt
        wrong = [(e["text"], e["gold"], e["predicted"]) for e in valid.errors[:MAX_ERRORS]]
        verdict = artifacts.cached(
            folder / "verdict.json", Verdict,
            lambda: generation.judge(spec, plan, history[: n + 1], self.store.counts(), wrong, self.roles.planner, config.target, config.warm_start),
        )
        result = RoundResult(n, used, metrics, valid, verdict, warm)
        (folder / "report.md").write_text(artifacts.report(spec, result, verdict, self._agreement()))
        return used, verdict

    def _agreement(self) -> dict[str, Agreement]:
        rows = self.store.agreement().collect()
        return {r["split"]: Agreement(r["agreed"], r["disagreed"], r["abstained"], r["rate"]) for r in rows}

    def _state(self, n: int) -> None:
        told = {k: dataclasses.asdict(a) for k, a in self._agreement().items()}
        artifacts.write_record(self.root / "run.json", RunState(dataclasses.asdict(self.config), n, told))

    def _first_data(self, spec: TaskSpec, plan: DataPlan, labeler) -> None:
        """Test data first; its writer sees no seeds, so it shares no raw material with training data."""
        config = self.config
        if self.store.load(Split.TEST).isEmpty():
            if config.corpus:
                rows, source = self._from_corpus(spec, plan, labeler, Pool.TEST, config.test_examples), self._source()
            else:
                bare = dataclasses.replace(plan, seeds=())
                rows = self._written(spec, bare, labeler, self.roles.evaluator, self.roles.generator, config.test_examples, (), config.seed + 1)
                source = self.roles.evaluator.name
            self.store.add(rows.withColumn("split", F.lit(Split.TEST.value)), 0, source)
        if self.store.load(Split.TRAIN, 0).isEmpty():
            self._add_train(spec, plan, labeler, 0, config.examples, (), config.seed + 2, True)

    def _more_data(self, spec: TaskSpec, plan: DataPlan, labeler, round_: int, focus) -> None:
        if self.store.load(Split.TRAIN, round_).isEmpty():
            seed = self.config.seed + 1000 * round_
            self._add_train(spec, plan, labeler, round_, self.config.examples_per_round, focus, seed, False)

    def _add_train(self, spec, plan, labeler, round_: int, count: int, focus, seed: int, required: bool) -> None:
        if self.config.corpus:
            rows, source = self._from_corpus(spec, plan, labeler, Pool.TRAIN, count, required), self._source()
        else:
            writer, checker = self.roles.generator, self.roles.evaluator
            rows, source = self._written(spec, plan, labeler, writer, checker, count, focus, seed), writer.name
        if not rows.isEmpty():
            split = split_train_valid(rows, "text", self.config.seed + round_, self.config.valid_ratio)
            self.store.add(split, round_, source)

    def _source(self) -> str:
        return f"corpus:{Path(self.config.corpus).name}"

    def _from_corpus(self, spec, plan, labeler, pool: Pool, count: int, required: bool = True) -> DataFrame:
        """Sampled passages of a pool that no stored text equals."""
        weights = quotas.corpus_weights(quotas.weight_frame(self.spark, plan.label_weights), spec.kind)
        wanted = quotas.as_dict(quotas.label_quotas(weights, count), "quota")
        passages = stored_passages(self.spark, self.config.corpus, self.config.corpus_max_chars)
        ranges = scan.positioned_ranges(passages)
        got = sampling.sample_ranges(ranges, labeler, pool.value, wanted, self.store.rows().select("norm"))
        filled = {r["bucket"]: r["count"] for r in got.rows.groupBy("bucket").count().collect()} if got.read else {}
        told = ", ".join(f"{k} {filled.get(k, 0)}/{n}" for k, n in wanted.items())
        if sum(filled.values()) < count:
            log.warning("corpus gave %s after %d passages%s", told, got.scanned, " (stalled)" if got.stalled else "")
        if required and not filled:
            raise CorpusError(f"no {pool} passage of {self.config.corpus} got a label")
        if pool is Pool.TEST and any(n and not filled.get(k) for k, n in wanted.items()):
            raise CorpusError(f"{self.config.corpus} leaves a bucket of the test set empty: {told}")
        return got.rows.select(F.col("position").alias("seq"), "text", "labels", "spans")

    def _written(self, spec, plan, labeler, writer, checker, count: int, focus, seed: int) -> DataFrame:
        """Written examples that hold: the labeler's word where it has one, else a second annotator's agreement."""
        written: set[str] = set()
        own = self.store.rows().filter(F.col("split") != Split.TEST.value)
        shown = [r["text"] for r in own.select("text").orderBy(F.xxhash64("text", F.lit(seed)), "id").limit(SHOWN).collect()]
        check = generation.annotator(spec, checker)

        def batch(n: int, batch_seed: int, base: int) -> DataFrame:
            known = self.store.rows().select("norm")
            if written:
                known = known.unionByName(self.spark.createDataFrame([(t,) for t in sorted(written)], "norm string"))
            made = generation.generate(
                self.spark, spec, plan, writer, n, known, shown, focus, self.config.workers, batch_seed
            )
            written.update(normalize_text(m["text"]) for m in made)
            rows = [(base + i, m["text"], m["labels"], m["spans"]) for i, m in enumerate(made)]
            drafts = self.spark.createDataFrame(rows, EXAMPLE)
            if labeler is not None:
                drafts = labelers.consulted(drafts, labeler)
            else:
                nothing = {"outcome": "string", "written_labels": "array<string>", "written_spans": EXAMPLE["spans"].dataType}
                drafts = drafts.withColumns({k: F.lit(None).cast(t) for k, t in nothing.items()})
            return gate(drafts, check, self.config.verify, workers=self.config.workers).checkpoint()

        kept = batch(count, seed, 0)
        missing = count - kept.count()
        if self.config.verify and missing > count * TOP_UP_SHARE:
            kept = kept.unionByName(batch(math.ceil(missing * TOP_UP_FACTOR), seed + 500, count))
        if kept.isEmpty():
            raise ProviderError(f"no usable examples from {writer.name}")
        return kept.orderBy("seq").limit(count)
