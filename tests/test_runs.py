from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import labelers
from textloom.plans import generation, model, providers
from textloom.plans.pipeline import Run, RunConfig
from textloom.sources import artifacts, corpus, store
from textloom.streaming import predict
from textloom.types import (
    NONE_KEY, Axis, DataPlan, Decision, HParamPatch, LabelDef, LabelScore, Metrics, RoundResult, Split, TaskKind, TaskSpec,
    TrainConfig, Verdict,
)

BINARY = TaskSpec("Is it good?", TaskKind.BINARY, (LabelDef("pos"), LabelDef("neg")))
SPANS = "array<struct<start:int,end:int,label:string>>"


def good_labeler(spec):
    return labelers.rule(F.when(F.contains("text", F.lit("good")), "pos").otherwise("neg"), F.contains("text", F.lit("apple")))


def scripted():
    """A provider made by value, so that workers need no test module."""

    class Scripted:
        name = "scripted"

        def ask(self, system, user, schema):
            wanted = schema["properties"]
            if "kind" in wanted:
                return {"kind": "binary", "labels": [{"name": "pos"}, {"name": "neg"}], "language": "en"}
            if "label_weights" in wanted:
                return {"label_weights": {"pos": 1.0, "neg": 1.0}, "axes": [{"name": "a", "values": ["x", "y", "z"]}]}
            if "decision" in wanted:
                return {"decision": "more_data", "reason": "more", "focus": ["f"]}
            if "index" in wanted["items"]["items"]["properties"]:
                lines = [line for line in user.split("\n") if line.startswith("[")]
                return {"items": [{"index": i, "labels": ["pos" if "good" in t else "neg"]} for i, t in enumerate(lines)]}
            import hashlib

            tag = hashlib.md5(user.encode()).hexdigest()[:6]
            return {"items": [{"text": f"{tag} text {i} is {'good' if i % 2 else 'bad'}", "labels": ["pos" if i % 2 else "neg"]} for i in range(8)]}

    return Scripted()


def test_store(spark, tmp_path):
    rows = [(0, "Hello  World", ["x", "y"], [], "train"), (1, "hello world", ["x"], [], "test"), (2, "b", ["x"], [], "train"), (3, "c", [], [], "train"),
            (4, "ab ab", [], [(0, 2, "H"), (3, 5, "H")], "test"), (5, "d", [], [], "test")]
    drafts = spark.createDataFrame(rows, f"seq long, text string, labels array<string>, spans {SPANS}, split string")
    kept = store.ExampleStore(spark, str(tmp_path / "s"))
    assert kept.add(drafts, 0, "me") == 5
    assert kept.add(drafts, 1, "me") == 0
    assert kept.counts() == {"train": {"x": 2, "y": 1, NONE_KEY: 1}, "valid": {}, "test": {"H": 2, NONE_KEY: 1}}
    assert [r["text"] for r in kept.texts(Split.TRAIN).collect()] == ["Hello  World", "b", "c"]
    assert kept.load(Split.TRAIN, 1).isEmpty() and kept.load(Split.TEST, 0).count() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """Writers that start from one version: norms and ids stay unique, versions are whole, readers keep theirs."""
    path = str(tmp_path / "s")
    schema = f"seq long, text string, labels array<string>, spans {SPANS}, split string"
    drafts = lambda texts: spark.createDataFrame([(i, t, ["x"], [], "train") for i, t in enumerate(texts)], schema)
    barrier, publish = threading.Barrier(2, timeout=120), store.ExampleStore._publish
    monkeypatch.setattr(store.ExampleStore, "_publish", lambda self, m: (m["version"] > 1 or barrier.wait() is not None) and publish(self, m))
    with ThreadPoolExecutor(2) as pool:
        added = list(pool.map(lambda t: store.ExampleStore(spark, path).add(drafts(t), 0, "me"), [["a", "b", "c"], ["B", "c", "d"]]))
    kept = store.ExampleStore(spark, path)
    rows = kept.rows().collect()
    assert sorted(r["norm"] for r in rows) == ["a", "b", "c", "d"] and len({r["id"] for r in rows}) == 4
    assert sorted(added) == [1, 3] and kept.version() == 2
    assert kept.rows(1).count() == 3 and kept.rows(0).count() == 0
    assert kept.add(drafts(["A"]), 1, "me") == 0 and kept.version() == 2
    (tmp_path / "s" / "batch=lost" / "split=train" / "round=0").mkdir(parents=True)
    assert kept.rows().count() == 4


def test_writer_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TRIES", 2)
    monkeypatch.setattr(store.ExampleStore, "_publish", lambda self, m: False)
    rows = spark.createDataFrame([(0, "a", ["x"], [], "train")], f"seq long, text string, labels array<string>, spans {SPANS}, split string")
    with pytest.raises(store.StoreConflict):
        store.ExampleStore(spark, str(tmp_path / "s")).add(rows, 0, "me")
    assert store.ExampleStore(spark, str(tmp_path / "s")).rows().count() == 0


def test_corpus_files(spark, tmp_path):
    import gzip

    (tmp_path / "c.txt").write_text("One good sentence here.\n\n  \nAnother bad sentence.\n")
    (tmp_path / "c.jsonl").write_text('{"text": "json text here", "source": "s"}\n\n')
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("zipped good line\n")
    assert [r["text"] for r in corpus.read_documents(spark, str(tmp_path / "c.txt")).collect()] == ["One good sentence here.", "Another bad sentence."]
    assert [r["text"] for r in corpus.read_documents(spark, str(tmp_path / "c.jsonl")).collect()] == ["json text here"]
    assert corpus.read_documents(spark, str(tmp_path / "d.txt.gz")).count() == 1
    got = corpus.read_passages(spark, str(tmp_path / "c.txt"), 40).orderBy("position").collect()
    assert [r["position"] for r in got] == [1, 2]
    for bad in ("c.csv", "c.gz", "corpus"):
        with pytest.raises(corpus.CorpusError):
            corpus.corpus_format(bad)
    (tmp_path / "e.jsonl").write_text('{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        corpus.read_documents(spark, str(tmp_path / "e.jsonl")).collect()


def test_corpus_run_resumes(spark, tmp_path, monkeypatch):
    words = ["river", "stone", "tree", "cloud", "bird", "lamp", "road", "song"]
    (tmp_path / "c.txt").write_text("".join(f"{words[i % 8]} {i} is {'good' if i % 3 else 'bad'}\n" for i in range(400)))
    monkeypatch.setattr(labelers, "load", lambda ref, spec: good_labeler(spec))
    config = RunConfig("r", "Is it good?", str(tmp_path / "runs"), labeler="m:f", corpus=str(tmp_path / "c.txt"), examples=16, test_examples=8,
                       examples_per_round=8, max_rounds=2, target=1.01)
    best = Run(spark, config, lambda _: scripted()).run()
    assert best.exists()
    rounds = artifacts.load_rounds(config.root)
    assert len(rounds) == 2 and rounds[0].verdict.decision is Decision.MORE_DATA
    stored = store.ExampleStore(spark, str(config.root / "examples"))
    assert stored.load(Split.TEST).count() == 8 and stored.load(Split.TRAIN, 1).count() == 7
    before = (config.root / "rounds/0/metrics.json").stat().st_mtime_ns
    Run(spark, config, lambda _: scripted()).run()
    assert (config.root / "rounds/0/metrics.json").stat().st_mtime_ns == before
    assert "## Verdict" in (config.root / "rounds/1/report.md").read_text()
    assert artifacts.status(rounds)[0].startswith(("*", " "))


def test_written_run(spark, tmp_path):
    config = RunConfig("w", "Is it good?", str(tmp_path), examples=12, test_examples=6, max_rounds=1, workers=2)
    Run(spark, config, lambda _: scripted()).run()
    stored = store.ExampleStore(spark, str(config.root / "examples"))
    assert stored.load(Split.TEST).count() == 6
    assert stored.texts().count() == stored.texts().distinct().count()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("anthropic:m", ("anthropic", "m", None)),
        ("codex", ("codex", None, None)),
        ("ollama:m", ("ollama", "m", None)),
        ("ollama:m@h", ("ollama", "m", "h")),
        ("local:m@http://h/v1", ("local", "m", "http://h/v1")),
    ],
)
def test_provider_specs(text, expected):
    spec = providers.parse_spec(text)
    assert (spec.kind.value, spec.model, spec.host) == expected


@pytest.mark.parametrize("bad", ["x:m", "anthropic", "anthropic:", "local:m", "ollama:@h"])
def test_bad_provider_specs(bad):
    with pytest.raises(ValueError):
        providers.parse_spec(bad)


def test_feedback_loop():
    schema = {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}
    replies = iter(["no json", '{"a": "x"}', '{"a": 3}'])
    turns = []
    assert providers.ask_with_feedback(schema, "u", lambda t: (turns.append(len(t)), next(replies))[1]) == {"a": 3}
    assert turns == [1, 3, 5]
    with pytest.raises(providers.ProviderError):
        providers.ask_with_feedback(schema, "u", lambda t: "nothing")


def test_base_models():
    assert model.base_model("base", "ja-JP") == "llm-jp/llm-jp-modernbert-base"
    assert model.base_model("large", "fi") == "jhu-clsp/mmBERT-base"
    assert model.base_model("me/mine", "en") == "me/mine"
    with pytest.raises(ValueError):
        model.base_model("huge", "en")


def test_span_model_and_json(spark):
    spec = TaskSpec("Mark numbers.", TaskKind.SPAN, (LabelDef("N"),))
    rows = spark.createDataFrame([(i, f"abc {i + 10} def {i}") for i in range(40)], "id long, text string")
    marked = labelers.pattern_spans("[0-9]+", "N")(rows)
    fitted = model.train(spec, marked, TrainConfig("mllib", epochs=2, weight_decay=0.0))
    assert model.evaluate(spec, fitted, marked).primary > 0.9
    line = json.loads(model.prediction_json(model.predict(spec, fitted, rows.limit(1))).first()["value"])
    assert {"text", "label", "start", "end", "score"} == set(line["spans"][0])


def test_warm_start_goes_on(spark):
    """A round that starts from the last one's coefficients begins with a lower loss than one that starts anew."""
    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}", ["pos" if i % 2 else "neg"]) for i in range(60)], "id long, text string, labels array<string>")
    first = model.train(BINARY, rows, TrainConfig("mllib", epochs=3))
    little = TrainConfig("mllib", epochs=0.1)
    cold, warm = model.train(BINARY, rows, little), model.train(BINARY, rows, little, first)
    loss = [m.stages[-1].summary.objectiveHistory[0] for m in (cold, warm)]
    assert loss[1] < 0.5 * loss[0]


def test_best_epoch_is_kept(spark):
    """Labels of the validation rows are turned round, so that every epoch is worse than the first."""
    rows = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} text {i}", ["pos" if i % 2 else "neg"]) for i in range(60)], "id long, text string, labels array<string>")
    turned = rows.withColumn("labels", F.when(F.get("labels", 0) == "pos", F.array(F.lit("neg"))).otherwise(F.array(F.lit("pos"))))
    config = TrainConfig("mllib", epochs=3, weight_decay=0.0)
    found = model.train_epochs(BINARY, rows, config, turned)
    assert len(found.losses) == 3 and found.best == 0 and min(found.losses) == found.losses[0]
    assert len(model.train_epochs(BINARY, rows, config, turned, patience=1).losses) == 2
    right = model.train_epochs(BINARY, rows, config, rows)
    assert right.losses[right.best] == min(right.losses) < 0.1 < found.losses[0]
    assert model.train_epochs(BINARY, rows, config, rows.limit(0)).losses == (None,)


def test_characters_where_words_hide_spans(spark, tmp_path):
    spec = TaskSpec("Mark numbers.", TaskKind.SPAN, (LabelDef("N"),))
    rows = spark.createDataFrame([(i, f"abc{i + 10}def ghi{i}jk") for i in range(40)], "id long, text string")
    marked = labelers.pattern_spans("[0-9]+", "N")(rows)
    assert model.token_context(marked) == model.CHARACTERS
    fitted = model.train(spec, marked, TrainConfig("mllib", epochs=2, weight_decay=0.0))
    found = model.evaluate(spec, fitted, marked)
    assert found.primary > 0.9 and found.unreachable_spans == 0


def test_predictions_over_a_stream(spark, tmp_path):
    """Equal lines of a batch are each given their own spans."""
    spec = TaskSpec("Mark numbers.", TaskKind.SPAN, (LabelDef("N"),))
    rows = spark.createDataFrame([(i, f"abc {i + 10} def {i}") for i in range(40)], "id long, text string")
    fitted = model.train(spec, labelers.pattern_spans("[0-9]+", "N")(rows), TrainConfig("mllib", epochs=2, weight_decay=0.0))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc 12 def 3\n\nabc 12 def 3\nabc 25 def 7\n")
    out: list[str] = []
    emit = lambda frame: out.extend(r["value"] for r in frame.collect())
    predict.predict_stream(spark, spec, fitted, str(tmp_path / "in"), emit, str(tmp_path / "state")).awaitTermination()
    assert sorted(json.loads(v)["text"] for v in out) == ["abc 12 def 3", "abc 12 def 3", "abc 25 def 7"]
    assert [len(json.loads(v)["spans"]) for v in out] == [2, 2, 2]


def test_prompts_tell_notes_scores_and_verdicts():
    plan = DataPlan({}, style_notes="dry", research_notes="people write briefly")
    asked = generation.request_prompt(BINARY, plan, [], (), (), (), ())
    assert "Style: dry" in asked and "What research found: people write briefly" in asked
    assert "research" not in generation.request_prompt(BINARY, DataPlan({}), [], (), (), (), ())
    scores = (LabelScore("pos", 0.5, 0.25, 1 / 3, 8),)
    verdict = Verdict(Decision.MORE_DATA, "few positives", ("irony",), HParamPatch(epochs=5))
    done = RoundResult(1, TrainConfig("m"), Metrics(0.7, 0.8, scores, 16), Metrics(0.6, 0.65, scores, 9, 2), verdict, 0)
    told = generation.judge_prompt(BINARY, plan, [done], {"train": {"pos": 3}}, [], 0.9, True)
    for part in ("from the model of round 0", "pos 0.500/0.250/0.333 of 8", "validation: 0.6000", "2 spans out of reach",
                 "few positives", "focus: irony", '"epochs": 5'):
        assert part in told, part


def test_judge_accepts_without_asking():
    result = RoundResult(0, TrainConfig("m"), Metrics(0.95, 0.9, (), 10))
    verdict = generation.judge(BINARY, DataPlan({}), [result], {}, [], None, 0.9, True)
    assert verdict.decision is Decision.ACCEPT


def test_cells_follow_weights(spark):
    plan = DataPlan({"pos": 0.8, "neg": 0.2}, (Axis("a", ("x", "y")),))
    cells = generation.sampled_cells(spark.range(2000).select(F.col("id").cast("string").alias("k")), "k", plan, 1)
    share = cells.select(F.avg((F.col("label") == "pos").cast("double"))).first()[0]
    assert 0.76 < share < 0.84
    assert generation.wave_size(10, 4) == 5 and generation.wave_size(1000, 4) == 12


def test_types_check():
    with pytest.raises(ValueError):
        TaskSpec("r", TaskKind.BINARY, (LabelDef("a"),))
    with pytest.raises(ValueError):
        HParamPatch(epochs=0)
    assert HParamPatch(epochs=5).apply(TrainConfig("m")).epochs == 5 and HParamPatch(epochs=0.5, batch_size=4096).given
    for bad in ({"learning_rate": 1.0}, {"max_length": 7}, {"warmup_ratio": 1.0}, {"weight_decay": -0.1}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            HParamPatch(**bad)
    with pytest.raises(ValueError):
        RunConfig("x", "rule", corpus="c.txt")
    with pytest.raises(ValueError):
        cli.merged({"name": "x", "rule": "a"}, {"name": "x", "rule": "b"}, True)
    again = TaskSpec.from_json(BINARY.to_json())
    assert again == BINARY


def test_norm_index(spark, tmp_path):
    """Segments merge, inserts need neither stored texts nor buckets without a hit, and a digest decides."""
    import shutil

    from textloom.sources import norms

    path = str(tmp_path / "s")
    schema = f"seq long, text string, labels array<string>, spans {SPANS}, split string"
    drafts = lambda texts: spark.createDataFrame([(i, t, ["x"], [], "train") for i, t in enumerate(texts)], schema)
    kept, sizes, stored = store.ExampleStore(spark, path), [], set()
    for texts in (["a", "A ", "b"], [f"t {i}" for i in range(40)], ["t 3", "c", None, None], ["b", "d"], [f"u {i}" for i in range(3)]):
        fresh = {t.strip().lower() for t in texts if t is not None} - stored
        assert kept.add(drafts(texts), 0, "me") == len(fresh) + texts.count(None)
        stored |= fresh
        sizes.append([s["rows"] for s in kept.segments()])
    assert sizes == [[2], [42], [42, 3], [42, 3, 1], [42, 7]]
    for folder in (tmp_path / "s").glob("batch=*"):
        shutil.rmtree(folder)
    assert kept.add(drafts(["T 39", "U 2", "a"]), 1, "me") == 0

    index = norms.NormIndex(spark, str(tmp_path / "n"))
    rows = spark.range(2000).selectExpr("id AS seq", "concat('x ', id) AS norm")
    many, most = norms.BUCKET_ROWS, 2000
    try:
        norms.BUCKET_ROWS = 100
        segments = index.extended([], rows, most)
    finally:
        norms.BUCKET_ROWS = many
    assert segments[0]["buckets"] == 20
    probe = rows.filter("seq = 7").unionByName(spark.range(2000, 2400).selectExpr("id AS seq", "concat('x ', id) AS norm"))
    assert {r["seq"] for r in index.insertable(probe, segments).collect()} == set(range(2000, 2400))
    own = norms._placed(rows.filter("seq = 7").select(norms.digest().alias("digest")), segments[0]).first()["bucket"]
    for folder in (tmp_path / "n" / segments[0]["name"] / "digests").glob("bucket=*"):
        if folder.name != f"bucket={own}":
            shutil.rmtree(folder)
    assert index.insertable(rows.filter("seq = 7"), segments).isEmpty()
    assert index.insertable(rows.filter("seq < 0"), segments).isEmpty()


def test_first_texts(spark, tmp_path):
    """State outlives a restart, the least of equal texts wins whenever it comes, rows behind the watermark are dropped."""
    at = lambda hour: datetime(2024, 1, 1 + hour // 24, hour % 24)
    arrivals = [[(5, "A a", at(1)), (6, "b", at(2)), (9, None, at(1))], [(3, "a  A", at(3)), (8, "B", at(50)), (10, None, at(50))], [(1, "a a", at(4)), (7, "b", at(51)), (2, "c", at(52))]]
    state, out, folder = (str(tmp_path / n) for n in ("state", "out", "in"))
    for rows in arrivals:  # each query starts anew from what the last one left
        spark.createDataFrame(rows, "n long, text string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        texts = predict.spark_stream(spark, folder, "n long, text string, ts timestamp")
        predict.dedup_stream(predict.first_texts(texts, "n", delay="10 hours", span="24 hours"), out, state).awaitTermination()
    found = predict.streamed_firsts(spark, out).collect()
    # 1 comes 40 hours after its window closed; the window of 50 hours has its own b
    assert sorted(r["n"] for r in found) == [2, 3, 6, 7, 9, 10]
    assert predict.streamed_firsts(spark, out).count() == predict.streamed_firsts(spark, out).select("n").distinct().count()
