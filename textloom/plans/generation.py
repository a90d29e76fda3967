"""Written examples: cells, prompts, waves of requests, planning and judging."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normalize_text
from textloom.operators import dedup, quotas, spans
from textloom.operators.verify import Annotator
from textloom.plans.providers import Provider, ProviderError, Researcher
from textloom.types import NONE_KEY, Axis, DataPlan, Decision, Metrics, RoundResult, TaskKind, TaskSpec, Verdict

LOOKALIKE_SHARE = 0.3
BATCH, LEAST_BATCH = 12, 5
FAILED_WAVES = 2
HARD_CASES, MOST_SEEDS, AVOIDED, RECENT, SNIPPET = 4, 3, 4, 4, 80


@dataclass(frozen=True)
class Cell:
    """What one example should be."""

    label: str
    axes: dict[str, str]
    lookalike: bool


def sample_cell(plan: DataPlan, rng: random.Random) -> Cell:
    """A label by weight, a value for each axis, now and then only a look-alike of the label."""
    positive = {k: w for k, w in plan.label_weights.items() if w > 0}
    label = rng.choices(list(positive), list(positive.values()))[0]
    axes = {a.name: rng.choice(a.values) for a in plan.axes}
    return Cell(label, axes, label != NONE_KEY and rng.random() < LOOKALIKE_SHARE)


def sampled_cells(keys: DataFrame, key: str, plan: DataPlan, seed: int) -> DataFrame:
    """``key, label, lookalike`` and a column for each axis, drawn from hashes of the key: any row alone gives its cell."""

    def share(tag: str) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", key, F.lit(f"{tag}:{seed}")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    positive = [(k, w) for k, w in plan.label_weights.items() if w > 0]
    total, below, label = sum(w for _, w in positive), 0.0, F.lit(positive[-1][0])
    cuts = []
    for name, weight in positive:
        below += weight / total
        cuts.append((below, name))
    for cut, name in reversed(cuts[:-1]):
        label = F.when(share("label") < cut, name).otherwise(label)
    columns = {"label": label}
    for axis in plan.axes:
        place = F.floor(share(axis.name) * len(axis.values)).cast("int")
        columns[axis.name] = F.get(F.array(*map(F.lit, axis.values)), place)
    found = keys.select(key).withColumns(columns)
    return found.withColumn("lookalike", (F.col("label") != NONE_KEY) & (share("lookalike") < LOOKALIKE_SHARE))


# --- prompts -------------------------------------------------------------------------------------------------------


def task_text(spec: TaskSpec) -> str:
    labels = "\n".join(f"- {d.name}: {d.description}" for d in spec.labels)
    parts = [f"Rule: {spec.rule}", f"Task: {spec.kind}", f"Language: {spec.language}", f"Labels:\n{labels}"]
    if spec.input_description:
        parts.append(f"Inputs: {spec.input_description}")
    if spec.decision_criteria:
        parts.append(f"Decide by: {spec.decision_criteria}")
    return "\n".join(parts)


SPEC_PROMPT = (
    "Turn a labeling rule into a task. Choose its kind: binary (two labels, exactly one holds), multiclass (exactly one of "
    "several), multilabel (any number, or none) or span (parts of the text are marked). Name each label in Latin letters, "
    "digits and underscores, beginning with a letter, and describe it so that two people would decide alike; a binary task "
    "needs a label for the case and one for its absence. Spans never overlap and are exact quotes. Say which texts the task "
    "is for, in which language, and how to decide at the border of the rule."
)
PLAN_PROMPT = (
    "Plan a data set for a labeling task. Give every label a weight (for tasks whose texts may have no label, also "
    f"{NONE_KEY}). Name three to six axes along which texts of any label vary, such as topic, register, length or place of "
    "the evidence, each with 4 to 8 short values; no axis may give the label away. List hard cases: texts that look like "
    "one label and have another. Describe style. Seeds are short, real-sounding texts from the research, and only from there."
)
JUDGE_PROMPT = (
    "Decide how to go on after a training round. accept: the result serves its purpose. more_data: say in focus, in a few "
    "items, what kinds of text are missing, told from the validation errors. tune: give only the options to change, when the "
    "data are enough but training is not. stop: more rounds would not help. Compare all rounds and give a short reason."
)


def research_prompt(spec: TaskSpec) -> str:
    return (
        f"{task_text(spec)}\n\nFind out what real texts for this task look like and what makes it hard. Write notes; then a "
        "line that only says EXAMPLES; then short example texts, one a line."
    )


def plan_prompt(spec: TaskSpec, research: str) -> str:
    return task_text(spec) + (f"\n\nResearch:\n{research}" if research else "")


def write_prompt(spec: TaskSpec) -> str:
    how = "Quote every marked part exactly as often as it occurs." if spec.kind is TaskKind.SPAN else "Use only the labels given."
    return f"Write realistic labeled texts for this task. {how}\n\n{task_text(spec)}"


def cell_line(number: int, cell: Cell, kind: TaskKind) -> str:
    target = "no label" if cell.label == NONE_KEY else cell.label
    if cell.lookalike:
        target = f"a text that looks like {cell.label} but is not"
    details = "; ".join(f"{k}: {v}" for k, v in cell.axes.items())
    return f"{number}. {target}" + (f" ({details})" if details else "")


def request_prompt(
    spec: TaskSpec, plan: DataPlan, cells: Sequence[Cell], hard: Sequence[str], focus: Sequence[str],
    avoid: Sequence[str], seeds: Sequence[str],
) -> str:
    def block(title: str, lines: Sequence[str]) -> str:
        return f"\n\n{title}:\n" + "\n".join(f"- {line}" for line in lines) if lines else ""

    wanted = "\n".join(cell_line(i + 1, c, spec.kind) for i, c in enumerate(cells))
    told = {"Style": plan.style_notes, "What research found": plan.research_notes}
    notes = "".join(f"\n\n{title}: {text}" for title, text in told.items() if text)
    return (
        f"Write {len(cells)} texts, one for each line:\n{wanted}{notes}"
        + block("Hard cases to cover", hard) + block("Focus", focus) + block("Unlike these", avoid) + block("In the vein of", seeds)
    )


def verify_prompt(spec: TaskSpec) -> str:
    return f"Label texts that somebody else wrote. Answer for every index.\n\n{task_text(spec)}"


def texts_prompt(texts: Sequence[str]) -> str:
    return "\n".join(f"[{i}] {t}" for i, t in enumerate(texts))


def score_line(metrics: Metrics) -> str:
    """Scores as one line: the two totals, then precision, recall and F1 of each label with its support."""
    each = [f"{s.label} {s.precision:.3f}/{s.recall:.3f}/{s.f1:.3f} of {s.support}" for s in metrics.per_label]
    lost = f"; {metrics.unreachable_spans} spans out of reach" if metrics.unreachable_spans else ""
    return f"{metrics.primary:.4f}, accuracy {metrics.accuracy:.4f} of {metrics.n_test}{lost}; " + ", ".join(each)


def round_lines(result: RoundResult) -> str:
    """What a round was trained with, its test and validation scores, and what was decided after it."""
    begun = "" if result.warm_from is None else f", from the model of round {result.warm_from}"
    lines = [f"round {result.round}{begun}: {result.config}", f"  test: {score_line(result.metrics)}"]
    if result.valid_metrics is not None:
        lines.append(f"  validation: {score_line(result.valid_metrics)}")
    if result.verdict is not None:
        patch = {k: v for k, v in asdict(result.verdict.hparams).items() if v is not None}
        lines.append(f"  decided: {result.verdict.decision.value}, {result.verdict.reason}")
        lines += [f"  focus: {', '.join(result.verdict.focus)}"] * bool(result.verdict.focus)
        lines += [f"  changed: {json.dumps(patch)}"] * bool(patch)
    return "\n".join(lines)


def judge_prompt(
    spec: TaskSpec, plan: DataPlan, history: Sequence[RoundResult], counts: dict[str, dict[str, int]],
    wrong: Sequence[tuple[str, str, str]], target: float, warm_start: bool,
) -> str:
    rounds = "\n".join(map(round_lines, history))
    errors = "\n".join(f"- {t[:300]!r}: gold {g}, predicted {p}" for t, g, p in wrong)
    return (
        f"{task_text(spec)}\n\nWeights: {plan.label_weights}\nTarget: {target}\nExamples: {json.dumps(counts)}\n"
        f"Next round {'continues from the last model' if warm_start else 'starts anew'}.\n\n{rounds}\n\nErrors:\n{errors}"
    )


# --- reply schemas -------------------------------------------------------------------------------------------------

_TEXT = {"type": "string"}
_TEXTS = {"type": "array", "items": _TEXT}
_QUOTES = {"type": "array", "items": {"type": "object", "properties": {"text": _TEXT, "label": _TEXT}, "required": ["text", "label"]}}


def _items(**properties: Any) -> dict[str, Any]:
    item = {"type": "object", "properties": properties, "required": list(properties)}
    return {"type": "object", "properties": {"items": {"type": "array", "items": item}}, "required": ["items"]}


def written_schema(spec: TaskSpec) -> dict[str, Any]:
    return _items(text=_TEXT, spans=_QUOTES) if spec.kind is TaskKind.SPAN else _items(text=_TEXT, labels=_TEXTS)


def verdict_schema(spec: TaskSpec) -> dict[str, Any]:
    index = {"type": "integer"}
    return _items(index=index, spans=_QUOTES) if spec.kind is TaskKind.SPAN else _items(index=index, labels=_TEXTS)


SPEC_SCHEMA = {
    "type": "object",
    "properties": {
        "kind": {"type": "string", "enum": [k.value for k in TaskKind]}, "language": _TEXT, "input_description": _TEXT,
        "decision_criteria": _TEXT,
        "labels": {"type": "array", "items": {"type": "object", "properties": {"name": _TEXT, "description": _TEXT}, "required": ["name"]}},
    },
    "required": ["kind", "labels"],
}
PLAN_SCHEMA = {
    "type": "object",
    "properties": {
        "label_weights": {"type": "object"}, "hard_cases": _TEXTS, "style_notes": _TEXT, "seeds": _TEXTS,
        "axes": {"type": "array", "items": {"type": "object", "properties": {"name": _TEXT, "values": _TEXTS}, "required": ["name", "values"]}},
    },
    "required": ["label_weights", "axes"],
}
JUDGE_SCHEMA = {
    "type": "object",
    "properties": {"decision": {"type": "string", "enum": [d.value for d in Decision]}, "reason": _TEXT, "focus": _TEXTS, "hparams": {"type": "object"}},
    "required": ["decision", "reason"],
}


# --- stages --------------------------------------------------------------------------------------------------------


def define_spec(rule: str, planner: Provider, attempts: int = 2) -> TaskSpec:
    """A task for a rule; a task that does not hold together goes back once with what is wrong."""
    user, problem = rule, ""
    for _ in range(attempts):
        draft = planner.ask(SPEC_PROMPT, user, SPEC_SCHEMA)
        try:
            return TaskSpec.from_dict({**draft, "rule": rule})
        except ValueError as error:
            problem = str(error)
            user = f"{rule}\n\nThe last task could not be used: {problem}"
    raise ProviderError(f"no valid task: {problem}")


def make_plan(spark: SparkSession, spec: TaskSpec, planner: Provider, researcher: Researcher | None) -> DataPlan:
    """Plan the data; failing research is no research."""
    notes = ""
    if researcher is not None:
        try:
            notes = researcher.research(research_prompt(spec)).strip()
        except ProviderError:
            notes = ""
    draft = planner.ask(PLAN_PROMPT, plan_prompt(spec, notes), PLAN_SCHEMA)
    weights = quotas.normalized_weights(spark, spec, draft["label_weights"])
    axes = spark.createDataFrame([(i, a["name"], a["values"]) for i, a in enumerate(draft["axes"])], "pos int, name string, values array<string>")
    seeds = spark.createDataFrame(list(enumerate(draft.get("seeds", []) if notes else [])), "pos int, text string")
    before = spark.createDataFrame([(notes,)], "n string").select(dedup.split_notes(F.col("n"))).first()[0]
    return DataPlan(
        quotas.as_dict(weights, "weight"),
        tuple(Axis(r["name"], tuple(r["values"])) for r in dedup.clean_axes(axes).orderBy("pos").collect()),
        tuple(c.strip() for c in draft.get("hard_cases", []) if c.strip()),
        draft.get("style_notes", "").strip(),
        before,
        tuple(r["text"].strip() for r in dedup.clean_seeds(seeds).collect()),
    )


def wave_size(missing: int, wave: int) -> int:
    """Examples to ask for in each call of a wave: a third more than is missing, within limits."""
    return min(BATCH, max(LEAST_BATCH, math.ceil(missing * 1.3 / wave)))


def _requests(rng: random.Random, spec: TaskSpec, plan: DataPlan, n: int, calls: int, shown: list[str], recent: list[str], focus):
    for _ in range(calls):
        cells = [sample_cell(plan, rng) for _ in range(n)]
        avoid = [*rng.sample(shown, min(AVOIDED, len(shown))), *recent[-RECENT:]]
        hard = rng.sample(plan.hard_cases, min(HARD_CASES, len(plan.hard_cases)))
        seeds = rng.sample(plan.seeds, rng.randint(0, min(MOST_SEEDS, len(plan.seeds)))) if plan.seeds else []
        yield request_prompt(spec, plan, cells, hard, focus, [t[:SNIPPET] for t in avoid], seeds)


def _asked(spark: SparkSession, spec: TaskSpec, writer: Provider, prompts: list[str]) -> DataFrame:
    """One wave: a partition for each request, replies in the order of requests."""
    system, schema = write_prompt(spec), written_schema(spec)
    wave = spark.createDataFrame(list(enumerate(prompts)), "call int, prompt string").repartition(len(prompts), "call")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for call, prompt in zip(frame["call"], frame["prompt"], strict=True):
                try:
                    reply = json.dumps(writer.ask(system, prompt, schema), ensure_ascii=False)
                except ProviderError:
                    reply = None
                out.append((call, reply))
            yield pd.DataFrame(out, columns=["call", "reply"])

    return wave.mapInPandas(run, "call int, reply string")


def parsed(replies: DataFrame, spec: TaskSpec) -> DataFrame:
    """Usable examples of replies in order: ``call, item, text, labels, spans``."""
    item = "struct<text:string,labels:array<string>,spans:array<struct<text:string,label:string>>>"
    each = replies.select("call", F.posexplode(F.from_json("reply", f"items array<{item}>")["items"]).alias("item", "r"))
    rows = each.select(
        "call", "item", "r.text", F.coalesce("r.labels", F.array()).alias("labels"), F.coalesce("r.spans", F.array()).alias("quoted")
    )
    if spec.kind is TaskKind.SPAN:
        return spans.span_items(rows, spec).select("call", "item", "text", F.array().cast("array<string>").alias("labels"), "spans")
    kept = spans.class_items(rows, spec)
    return kept.select("call", "item", "text", "labels", F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))


def generate(
    spark: SparkSession, spec: TaskSpec, plan: DataPlan, writer: Provider, count: int, stored: DataFrame, shown: list[str],
    focus: Sequence[str] = (), workers: int = 4, seed: int = 0, max_calls: int | None = None,
) -> list[dict[str, Any]]:
    """Up to ``count`` new examples in order of requests; stops when the budget is spent or waves keep failing.

    ``count`` is what a data set of written examples needs, so examples pass through the driver. ``stored`` (``norm``)
    does not: each wave's norms are looked up in it.
    """
    rng = random.Random(seed)
    budget = max_calls or max(workers, 3 * math.ceil(count / BATCH))
    keys: set[str] = set()
    out: list[dict[str, Any]] = []
    calls = failed = 0
    while len(out) < count and calls < budget and failed < FAILED_WAVES:
        wave = min(workers, budget - calls)
        n = wave_size(count - len(out), wave)
        prompts = list(_requests(rng, spec, plan, n, wave, shown, [o["text"] for o in out], focus))
        replies = _asked(spark, spec, writer, prompts).cache()
        calls += wave
        failed = failed + 1 if replies.filter("reply is not null").isEmpty() else 0
        made = dedup.with_norm(parsed(replies, spec)).cache()
        known = stored.select("norm").join(F.broadcast(made.select("norm").distinct()), "norm", "left_semi").distinct()
        keys.update(r["norm"] for r in known.collect())
        for row in made.orderBy("call", "item").collect():
            key = normalize_text(row["text"])
            if key not in keys and len(out) < count:
                keys.add(key)
                out.append({"text": row["text"], "labels": list(row["labels"]), "spans": [s.asDict() for s in row["spans"]]})
        made.unpersist()
        replies.unpersist()
    return out


def annotator(spec: TaskSpec, checker: Provider) -> Annotator:
    """A provider as an annotator for ``verify``."""
    system, schema = verify_prompt(spec), verdict_schema(spec)

    def run(texts: list[str]):
        items = checker.ask(system, texts_prompt(texts), schema)["items"]
        return [
            (i["index"], i.get("labels", []), [(s["text"], s["label"]) for s in i.get("spans", [])]) for i in items
        ]

    return run


def judge(
    spec: TaskSpec, plan: DataPlan, history: Sequence[RoundResult], counts: dict[str, dict[str, int]],
    wrong: Sequence[tuple[str, str, str]], planner: Provider, target: float, warm_start: bool,
) -> Verdict:
    """Accept without asking when any round reached the target, else ask."""
    top = max(r.metrics.primary for r in history)
    if top >= target:
        return Verdict(Decision.ACCEPT, f"best primary {top:.4f} reached target {target}")
    user = judge_prompt(spec, plan, history, counts, wrong, target, warm_start)
    return Verdict.from_dict(planner.ask(JUDGE_PROMPT, user, JUDGE_SCHEMA))
