"""Protocols, stages, selection, conversion, sources and streams on small inputs."""

import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import audit, convert, grading, prompts, resume, select
from gradeloom.plans import protocol as P
from gradeloom.sources import readers
from gradeloom.streaming import micro_batch

OPTION = "array<struct<letter:string,text:string>>"
SHEET = f"id int, gt array<string>, gt_is_list boolean, pred array<string>, question string, options {OPTION}, choices array<string>, flat_options {OPTION}, prompt string"
THINGS = [("A", "clay pot"), ("B", "paper kite"), ("C", "lamp"), ("D", "spoon")]


def sheet(spark, *rows):
    return spark.createDataFrame([(i, g, g is not None and len(g) > 1, p, q, o, None, None, None) for i, (g, p, q, o) in enumerate(rows)], SHEET)


def verdicts(df):
    return [(r.decided_by, r.is_correct, r.status) for r in df.orderBy("id").collect()]


def test_rule_stages(spark):
    rows = sheet(
        spark, (["B"], ["b"], "", THINGS), (["A"], ["A clay pot"], "", THINGS), (["C"], ["It shows a lamp"], "", THINGS), (["24"], ["24%"], "", None), ([" "], ["x"], "", None), (["Paris", "paris france"], ["Final answer: Paris"], "", None),
        (["x"], None, "", None), (["E"], ["(E) it is"], "(A) a (B) b", None),
    )
    out = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "exact-match,rule-match"}))
    assert verdicts(out) == [
        ("exact-match", 1, "ok"), ("rule-match", 1, "ok"), ("rule-match", 1, "ok"), (None, 0, "ok"), (None, 0, "invalid"), ("rule-match", 1, "ok"), (None, 0, "invalid"), ("rule-match", 1, "ok"),
    ]
    s = grading.summarize(out).first()
    assert (s.total, s.valid, s.correct, s.invalid) == (8, 6, 5, 2)


def test_model_stages_run_on_the_rest_only(spark):
    rows = sheet(spark, (["blue"], ["blue"], "", None), (["blue"], ["azure"], "", None), (["blue"], ["break"], "", None))

    def client():
        def reply(texts):
            assert all("RESPONSE: blue" not in t for t in texts)
            return ["nonsense" if "break" in t else '{"is_correct": 1, "reason": "same"}' for t in texts]

        return reply

    out = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "exact-match,llm-judge"}), client, trace=True)
    got = {r.id: (r.decided_by, r.score, r.reason, len(r.trace)) for r in out.collect()}
    assert got[0] == ("exact-match", 1.0, None, 1)
    assert got[1] == ("llm-judge", 1.0, None, 2)
    assert got[2][0] is None and got[2][2].startswith("llm_error")


def counting_client(folder, reply):
    """A client that leaves a line for each prompt it gets; reply(prompt, number of times asked before) is its answer."""

    def make():
        def client(texts):
            out = []
            for t in texts:
                path = folder / f"{zlib.crc32(t.encode())}"
                before = len(path.read_text()) if path.exists() else 0
                with path.open("a") as f:
                    f.write("x")
                out.append(reply(t, before))
            return out

        return client

    return make


def asked(folder):
    return sorted(len(p.read_text()) for p in folder.iterdir())


def test_two_model_stages_ask_each_row_once(spark, tmp_path):
    rows = sheet(
        spark, (["B"], ["the one with wings"], "pick <image>", THINGS), (["B"], ["something odd"], "", THINGS), (["B"], ["b"], "", THINGS), (["A", "C"], ["both vessels"], "", THINGS), (["blue"], ["azure"], "", None), (["C"], ["It is option C"], "", THINGS),
        (["A,C"], ["pot and light"], "", THINGS), (["B"], ["broken"], "", THINGS),
    )

    def reply(prompt, before):
        if prompt.startswith("Which option"):
            assert "<image>" not in prompt
            return "I think it is B" if "wings" in prompt else "A, C" if "light" in prompt else "D" if before == 0 else "B"  # a model that changes its mind
        return grading.Reply('{"is_correct": 1, "reason": "close"}', (("{", -0.1), (' "1"', -0.5), ("0", -3.0))) if "azure" in prompt else '{"is_correct": 0}' if before == 0 else '{"is_correct": 1}'

    out = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "exact-match,llm-match,llm-judge"}), counting_client(tmp_path, reply), pause=0.0, include_reason=True).drop("id", "x").withColumn("id", F.col("gt_shown"))
    got = out.select("pred", "decided_by", "score", "judge_prob", "reason").collect()
    assert out.count() == len(got) == 8 and set(asked(tmp_path)) == {1}
    by = {r.pred[0]: r for r in got}
    assert by["the one with wings"].decided_by == "llm-match" and by["It is option C"].decided_by == "llm-match" and by["b"].decided_by == "exact-match" and by["pot and light"].decided_by == "llm-match"
    assert (by["something odd"].decided_by, by["something odd"].score) == ("llm-judge", 0.0)
    assert by["azure"].score == 1.0 and abs(by["azure"].judge_prob - math.exp(-0.5)) < 1e-12 and by["azure"].reason == "close" and by["broken"].judge_prob is None
    assert grading.summarize(out).first().judge_prob_mean == by["azure"].judge_prob


def test_failures_are_tried_again_or_told(spark, tmp_path):
    class RateLimitError(Exception):
        pass

    class Denied(Exception):
        status_code = 401

    rows = sheet(spark, (["x"], ["busy"], "", None), (["x"], ["denied"], "", None), (["x"], ["silent"], "", None), (["x"], ["dead"], "", None))

    def reply(prompt, before):
        if "busy" in prompt:
            return RateLimitError("slow down") if before == 0 else '{"is_correct": 1}'
        return Denied("no") if "denied" in prompt else " " if "silent" in prompt else RateLimitError("never")

    out = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "llm-judge"}), counting_client(tmp_path, reply), attempts=3, pause=0.0)
    got = {r.pred[0]: (r.decided_by, r.reason) for r in out.collect()}
    assert got == {"busy": ("llm-judge", None), "denied": (None, "llm_error: Denied: no"), "silent": (None, "llm_error: empty_response"), "dead": (None, "llm_error: RateLimitError: never")}
    assert asked(tmp_path) == [1, 2, 3, 3]
    assert grading.summarize(out).first().llm_errors == 3


def test_responses_in_passes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, prompt string")

    def reply(prompt, before):
        return "" if prompt == "b" and before == 0 else f"re {prompt}"

    client = counting_client(tmp_path, reply)
    with pytest.raises(grading.TooManyFailures):
        grading.respond(rows, "prompt", client, budget=0, attempts=1)
    out = grading.respond(rows, "prompt", client, passes=3, budget=1, attempts=1).orderBy("id").collect()
    assert [(r.pred, r.response_error) for r in out] == [(["re a"], None), (["re b"], None), (None, None)]


def test_replies_from_a_table(spark):
    rows = grading.with_context(sheet(spark, (["x"], ["y"], "", None), (["x"], ["z"], "", None), (["x"], ["x"], "", None)))
    replies = spark.createDataFrame([(0, '{"is_correct": true}'), (2, '{"is_correct": false}')], "id int, reply string")
    out = grading.grade(rows, P.resolve_protocol({"score_pipeline": "exact-match,llm-judge"}), replies={"llm-judge": replies}, key="id")
    assert verdicts(out) == [("llm-judge", 1, "ok"), (None, 0, "ok"), ("exact-match", 1, "ok")]


def test_texts_as_they_are(spark):
    wide = "\uff11\uff12"  # two full-width digits
    fish = "\ufb01sh"  # with a ligature
    rows = sheet(spark, ([wide], [wide], "", None), ([fish] * 3, [fish], "", None), (["x", "y", None], ["x"], "", None))
    anls = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "anls"}))
    assert [r.score for r in anls.orderBy("id").collect()] == [1.0, 1.0, 1.0]
    vqa = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "vqa-accuracy"})).orderBy("id").collect()
    assert [(r.status, round(r.score, 6)) for r in vqa] == [("invalid", 0.0), ("ok", round(2 / 3, 6)), ("ok", round(0.5 / 3, 6))]
    loose = grading.grade(grading.with_context(rows), P.resolve_protocol({"score_pipeline": "exact-match", "string_match": "anls"}))
    assert [r.is_correct for r in loose.orderBy("id").collect()] == [1, 1, 1]


def test_empty_sheet(spark):
    out = grading.grade(grading.with_context(sheet(spark).limit(0) if False else spark.createDataFrame([], SHEET)), P.resolve_protocol())
    s = grading.summarize(out).first()
    assert (s.total, s.accuracy, s.mean_score) == (0, 0.0, 0.0)


def test_protocols():
    assert P.parse_pipeline("exact-match, anls") == ["exact-match", "anls"]
    for bad in ("", "anls,exact-match", "exact-match,exact-match", "nope"):
        with pytest.raises(P.ProtocolError):
            P.parse_pipeline(bad)
    refused = {"score_pipeline": {"unsupported": "cider", "reason": "corpus metric"}}
    with pytest.raises(P.ProtocolError):
        P.resolve_protocol({}, refused)
    forced = P.resolve_protocol({"score_pipeline": "exact-match"}, refused)
    assert forced.official is False and forced.notes
    own = P.resolve_protocol({}, {"score_pipeline": ["anls"], "score_params": {"threshold": 0.3}})
    assert (own.pipeline, own.anls_threshold, own.official, own.sources["anls_threshold"]) == (("anls",), 0.3, True, "dataset")
    assert P.resolve_protocol({}, {"score_pipeline": []}).official is False
    assert P.resolve_protocol().official is None
    a, b = P.resolve_protocol(), P.resolve_protocol({"numeric_rel_tol": 0.05})
    assert a.fingerprint() != b.fingerprint() and a.fingerprint(judge_model="x") == a.fingerprint()
    with pytest.raises(P.ProtocolError):
        P.one_meta([{"a": 1}, {"a": 2}])


def test_selection(spark):
    rows = select.with_position(spark.range(100).select((99 - F.col("id")).alias("k")), ["k"])
    assert [r.position for r in rows.orderBy("k").collect()] == list(range(100))
    drawn = select.random_rows(rows, 7, 3, 100)
    assert [r.position for r in drawn.orderBy("ordinal").collect()] == random.Random(3).sample(range(100), 7)
    with pytest.raises(ValueError):
        select.select_rows(rows, "sideways", 1, 100)
    chunks = [select.contiguous_chunk(rows, 7, k, 100).count() for k in range(7)]
    assert chunks == [15, 15, 15, 15, 15, 15, 10]


def test_sample_draws_from_the_whole_table(spark, tmp_path):
    from gradeloom.plans import registry

    spark.range(4000).select((F.col("id") * 3).alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["sample_random_seeded"](spark, str(tmp_path)).collect()
    want = random.Random(11).sample(range(4000), 50)
    assert [r.position for r in sorted(got, key=lambda r: r.ordinal)] == want
    assert all(r.o_orderkey == 3 * r.position for r in got)


def test_resume(spark):
    cache = spark.createDataFrame([("1", "a", None), ("2", "a", "llm_error: x"), ("3", "b", None)], "eval_id string, fingerprint string, reason string")
    use = resume.reusable(cache, "a")
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,)], "eval_id long")
    done, todo = resume.split_work(rows, use, "eval_id")
    assert done.count() == 1 and todo.count() == 3


def test_conversion(spark):
    with pytest.raises(ValueError):
        convert.parse_mapping(["id=a", "id=b", "question=c"])
    rows = spark.createDataFrame([(1, [(1, "p"), (2, "q")]), (2, [])], "id long, subs array<struct<n:int,text:string>>")
    out = [(r._unique_id, r.n, r.text) for r in convert.explode_rows(rows, "subs").orderBy("_unique_id").collect()]
    assert out == [("1_0", 1, "p"), ("1_1", 2, "q")]
    kept, rejected = convert.require_ids(spark.createDataFrame([("a/b", 0), (None, 1)], "id string, position int"))
    assert [r.id for r in kept.collect()] == ["a_b"] and rejected.first().reason == "missing_required:id"
    modes = spark.createDataFrame([("zzz",), ("multi_image_start",), ("text",)], "modality string")
    assert convert.ordered_modalities(modes).first().modalities == ["text", "multi_image_start", "zzz"]


def test_templates(spark):
    source = "{{ question }}{% if options %}\n{% for k, v in options.items() %}{{ k }}) {{ v }} {% endfor %}{% endif %}"
    df = spark.createDataFrame([("q", [("A", "x"), ("B", "y")]), ("r", None)], f"question string, options {OPTION}")
    out = [r.p for r in df.select(prompts.template_prompt(source, {"question": F.col("question"), "options": F.col("options")}).alias("p")).collect()]
    assert out == ["q\nA) x B) y ", "r"]
    with pytest.raises(ValueError):
        prompts.compile_template("{% if x %}")


def test_readers(spark, tmp_path):
    rows = [
        {"id": "a", "answer": "B", "messages": [{"role": "user", "question": "q", "options": {"A": "x", "B": "y"}}, {"role": "assistant", "response": ["b"]}]},
        {"id": "b", "answer": ["Paris", "paris"], "messages": [{"role": "user", "question": "q"}, {"role": "assistant", "response": "Paris"}]},
        {"id": "c", "answer": " ", "reference_response": "x", "messages": [{"role": "user", "question": "q"}, {"role": "assistant", "response": "[x]"}]},
    ]
    (tmp_path / "result.json").write_text(json.dumps(rows))
    got = readers.read_results(spark, str(tmp_path / "result.json"))
    out = grading.grade(grading.with_context(got), P.resolve_protocol({"score_pipeline": "exact-match"}))
    assert [(r.eval_id, r.gt, r.pred, r.is_correct) for r in out.orderBy("eval_id").collect()] == [(0, ["B"], ["b"], 1), (1, ["Paris", "paris"], ["Paris"], 1), (2, ["x"], ["[x]"], 0)]
    (tmp_path / "b.tsv").write_text('question\tA\tB\timage\nfirst\tx\t\t"[\'p.png\', \'q.png\']"\n')
    row = readers.open_source(spark, str(tmp_path / "b.tsv"), columns=["question", "A", "B", "image"]).first()
    assert row.choices == ["A"] and row.media == ["p.png", "q.png"]
    with pytest.raises(ValueError):
        readers.open_source(spark, "what@ever")
    assert readers.choose_subset({"subsets": {"x": {}}}) == "x"


def test_more_sources(spark, tmp_path):
    for name, rows in (("a.tsv", ["one\t5", "two\t"]), ("b.tsv", ["three\t"])):
        (tmp_path / name).write_text("question\teval-id\n" + "\n".join(rows) + "\n")
    got = readers.read_tsv(spark, [str(tmp_path / "b.tsv"), str(tmp_path / "a.tsv")], ["question", "eval-id"])
    assert {(r.question, r.eval_id) for r in got.collect()} == {("one", 5), ("two", 1), ("three", 2)}
    (tmp_path / "own.json").write_text('[{"id": "a", "eval-id": 3}]')
    with pytest.raises(Exception, match="eval-id already"):
        readers.open_source(spark, f"local@{tmp_path}/own.json").collect()
    (tmp_path / "two.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert [(r.eval_id, json.loads(r.sample.toJson())["id"]) for r in readers.open_source(spark, f"local@{tmp_path}/two.json").orderBy("eval_id").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "x.jsonl").write_text('{"eval-id": 7}\n\n{"id": 1}\n')
    assert sorted((r.eval_id or 0) for r in readers.open_source(spark, f"lines@{tmp_path}/x.jsonl").collect()) == [0, 7]
    (tmp_path / "x.txt").write_text("{'a': None, 'b': (1, 2)}\n{\"a\": \"t\", \"b\": [3]}\nnot one\n{'a': True}\n")
    got = readers.read_literal_lines(spark, str(tmp_path / "x.txt"), "a string, b array<int>").collect()
    assert [(r.a, r.b) for r in got] == [(None, [1, 2]), ("t", [3]), (None, None), ("true", None)]
    assert readers.fetch(spark, str(tmp_path / "x.txt"), str(tmp_path / "copy.txt")) and not readers.fetch(spark, str(tmp_path / "own.json"), str(tmp_path / "copy.txt"))
    assert (tmp_path / "copy.txt").read_text() == (tmp_path / "x.txt").read_text()
    (tmp_path / "B.tsv").write_text("question\tA\nq\tx\n")
    assert readers.open_source(spark, "named@B", listed=["B"], folder=str(tmp_path), columns=["question", "A"]).first().eval_id == 0
    with pytest.raises(ValueError):
        readers.named_benchmark("C", ["B"], "/x")

    def load(name):
        if name == "bad":
            raise OSError("gone")
        return spark.createDataFrame([(name,)], "v string") if name == "x" else spark.createDataFrame([(1,)], "w int")

    rows, errors = readers.per_subject(["x", "bad", "y"], load)
    assert [(r.subject, r.subject_no, r.v, r.w) for r in rows.orderBy("subject_no").collect()] == [("x", 0, "x", None), ("y", 2, None, 1)] and errors == {"bad": "OSError: gone"}
    for split in ("train", "test"):
        spark.range(2).write.parquet(f"{tmp_path}/art/default/{split}")
    assert readers.splits_of(spark, f"{tmp_path}/art", "main") == ["test", "train"]
    assert readers.open_source(spark, f"artifact@{tmp_path}/art", split="test", manifest={"subsets": {"main": {}}}).first().media == []
    told = {name: (kind, kinds) for name, kind, kinds, _ in readers.inspect(spark.createDataFrame([('{"a": 1}', 2), ("plain", None)], "t string, n int"))}
    assert told["n"] == ("int", ["int"]) and "string" in told["t"][1] and len(told["t"][1]) == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(10, "x"), (9, None), (100, 'q"')], "id int, t string")
    readers.write_json_array(rows, f"{tmp_path}/result.json", "id")
    assert json.loads((tmp_path / "result.json").read_text()) == [{"id": 9}, {"id": 10, "t": "x"}, {"id": 100, "t": 'q"'}]
    readers.write_json_array(rows, f"{tmp_path}/data.json", "id", as_text=True)
    assert [r["id"] for r in json.loads((tmp_path / "data.json").read_text())] == [10, 100, 9]
    readers.write_json_array(rows.limit(0), f"{tmp_path}/none.json", "id")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    batches = select.batches(select.with_position(spark.range(10), ["id"]), 4)
    readers.write_batches(batches.where("batch < 2").withColumn("v", F.lit(1)), f"{tmp_path}/b")
    out = readers.write_batches(batches.withColumn("v", F.lit(2)), f"{tmp_path}/b")
    assert {(r.id, r.v) for r in out.collect()} == {(i, 1 if i < 8 else 2) for i in range(10)}
    readers.write_scores(rows, rows.limit(1), {"a": 1}, f"{tmp_path}/scores")
    config = json.loads(spark.read.text(f"{tmp_path}/scores/config").first().value)
    assert config["a"] == 1 and config["provenance"]["spark"]


def test_manifests(spark, tmp_path):
    block = {"modalities": ["text"], "media_min": 0, "media_max": 2, "source": {"format": "tsv", "url": {"test": "u"}}, "mapping": {"question": {"from": "q"}, "extra": {"cat": {"from": "c"}}}}
    made = convert.build_manifest("set", "2024-01-02", "main", block)
    assert made["subsets"]["main"]["language"] == ["en"] and made["subsets"]["main"]["mapping_from_source"]["media"] == {"min_items": 0, "max_items": 2}
    assert convert.mapping_of_manifest(made["subsets"]["main"]["mapping_from_source"]) == {"question": "q", "cat": "c"}
    seed = json.loads(json.dumps(made))
    seed["release_date"] = "2025-01-01"
    seed["subsets"]["main"] |= {"task_type": "open_qa", "note": "kept"}
    seed["subsets"]["main"]["mapping_from_source"]["source"] |= {"links": {"dev": "v"}, "repo": "r"}
    again = convert.build_manifest("other", "2024-06-01", "main", {**block, "media_max": 3, "source": {"url": {"train": "w"}}, "extra": {"level": "lv"}}, seed)
    sub = again["subsets"]["main"]
    assert again["name"] == "set" and again["release_date"] == "2025-01-01" and sub["task_type"] == "open_qa" and sub["note"] == "kept"
    assert sub["mapping_from_source"]["source"] == {"format": "tsv", "url": {"dev": "v", "test": "u", "train": "w"}} and sub["mapping_from_source"]["extra"] == {"cat": {"from": "c"}, "level": {"from": "lv"}}
    with pytest.raises(ValueError):
        convert.build_manifest("x", "2024-01-01", "absent", block, seed)
    readers.write_manifest(spark, again, f"{tmp_path}/metadata.json")
    assert json.loads((tmp_path / "metadata.json").read_text()) == again


def test_runs_and_options():
    done, failed = P.each_file(["a", "b"], lambda f: 1 // (f == "a"))
    assert done == {"a": 1} and failed["b"].startswith("ZeroDivisionError")
    assert set(P.provenance()) == {"git_commit", "python", "spark"}
    given = P.generation_options({"top_p": 0.5, "max_new_tokens": None, "odd": 1}, {"max_new_tokens": 9})
    assert given == {"max_new_tokens": 9, "top_p": 0.5}
    assert P.fit_options(given, lambda max_completion_tokens: 0) == ({"max_completion_tokens": 9}, ["top_p"])
    assert P.fit_options(given, lambda **more: 0)[0] == {"max_completion_tokens": 9, "top_p": 0.5}


def test_saved_rows_and_ids(spark):
    kind = "id int, media array<binary>, messages array<struct<role:string,media:array<string>,response:string>>"
    row = convert.scrub_media(spark.createDataFrame([(1, [b"x", None], [("user", ["m"], None)])], kind)).first()
    assert row.media == ["Image Object", None] and row.messages[0].asDict() == {"role": "user", "response": None}
    ids = convert.unique_ids(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "id string, n int"), ["n"])
    assert sorted(((r.id, r.n) for r in ids.collect()), key=str) == sorted([("a_q1", 1), ("a_q2", 2), ("b", 3), (None, 4), (None, 5)], key=str)
    with pytest.raises(ValueError):
        select.random_positions(select.MAX_DRAW + 1, None, 1)
    merged = convert.merge_subsets({("x", "test"): spark.range(1), ("y", "test"): spark.range(2)})
    assert {(r.split, r["count"]) for r in merged.groupBy("split").count().collect()} == {("x_test", 1), ("y_test", 2)}
    with pytest.raises(Exception, match="no series for odd"):
        resume.series_of(spark.createDataFrame([("odd",)], "model string"), spark.createDataFrame([("s", ["m"])], "series string, models array<string>"), strict=True).collect()
    text = spark.createDataFrame([("k", 1, "<image> <image>", ["m"])], "k string, n int, t string, media array<string>")
    with pytest.raises(Exception, match="too few media for k"):
        prompts.message_media(text, "k", "n", "t", "media", strict=True).collect()


def test_audits(spark):
    rows = spark.createDataFrame([(1, "see <image>", ["a"]), (2, "<image> <image>", ["a"]), (3, "<image>", [])], "id int, q string, media array<string>")
    found = {(r.id, r.issue) for r in audit.placeholder_issues(rows, "id", F.col("q"), F.col("media")).collect()}
    assert found == {(2, "placeholder mismatch"), (3, "placeholder mismatch"), (3, "placeholder without media")}


def test_stream(spark, tmp_path):
    sheet(spark, (["B"], ["b"], "", THINGS), (["B"], ["c"], "", THINGS)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SHEET).parquet(str(tmp_path / "in"))
    run = micro_batch.grade_stream(stream, P.resolve_protocol(), lambda df, n: df.select("id", "is_correct").write.mode("overwrite").parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "cp"))
    run.awaitTermination(120)
    assert {(r.id, r.is_correct) for r in spark.read.parquet(str(tmp_path / "out/0")).collect()} == {(0, 1), (1, 0)}
