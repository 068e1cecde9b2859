"""Profiles, personas, skims, summaries; sources of requests; what is left of a job."""

import http.server
import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from textloom import job
from textloom.functions import clean
from textloom.generation import analysis, rounds
from textloom.generation.backend import Stub, factory
from textloom.operators import discover
from textloom.sources import loading, readers

GOOD = {"domain": " pumps ", "source_kind": "manual", "instruction_guidance": "Name it.", "answer_guidance": "Be brief."}


class Says:
    """A backend that gives answers in turn."""

    model_name = "says"

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def generate_json(self, system, prompt, *, max_new_tokens=0, enable_thinking=False):
        self.asked.append(prompt)
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got


def person(name):
    return {"name": name, "description": "d", "chunk_level": "section", "question_style": "s"}


def test_profiles_are_checked():
    p = analysis.Profile.of(GOOD | {"avoid": ["x", " ", 3]})
    assert p.domain == "pumps" and p.avoid == ("x",) and p.recommended_chunk_level is None
    for bad in (GOOD | {"domain": " "}, GOOD | {"avoid": "x"}, GOOD | {"recommended_chunk_level": "word"}, [], {k: v for k, v in GOOD.items() if k != "answer_guidance"}):
        with pytest.raises(ValueError):
            analysis.Profile.of(bad)


def test_profiles_are_normalized():
    p = analysis.Profile.of(GOOD | {"preferred_task_types": ["Define a term", "define-a-term", "define a_term"], "instruction_guidance": "Ask, e.g. what is it?"}).normalized()
    assert p.preferred_task_types == ("define_or_clarify_term", "explain_mechanism_or_reasoning", "transform_summarize_or_structure")
    assert p.instruction_guidance == analysis.PLAIN_GUIDANCE and set(analysis.AVOIDED) <= set(p.avoid)
    many = analysis.Profile.of(GOOD | {"preferred_task_types": [f"task_{i}" for i in range(9)], "avoid": [f"No {a}" for a in analysis.AVOIDED]}).normalized()
    assert len(many.preferred_task_types) == 6 and len(many.avoid) == 2 and many.instruction_guidance == "Name it."
    other = analysis.Profile.of(GOOD | {"preferred_task_types": ["List all criteria", "recommend treatment now", "first-line treatment of it"]}).normalized()
    assert other.preferred_task_types == (analysis.CRITERIA_LABEL, analysis.TREATMENT_LABEL)


def test_task_labels(spark):
    tasks = ["", "short_label", "two words", "Two Words", "Explain how it works", "list each metric", "identify parts", "help me", "a much longer task that goes on", "walk through", "x-y", "Compare", "ALLCAPS"]
    want = ["", "short_label", "two words", "Two Words", "explain_mechanism_or_application", "identify_supported_metrics", "extract_supported_facts_or_assets", "apply_rule_or_procedure", "a_much_longer_task", "walk through", "x-y", "compare_or_differentiate", "ALLCAPS"]
    assert [analysis.task_label(t) for t in tasks] == want
    assert [r[0] for r in spark.createDataFrame([(t,) for t in tasks], "t string").coalesce(1).select(analysis.task_labels(F.col("t"))).collect()] == want
    assert analysis.spread_tasks(["a", " ", "b"], 5) == ["a", "b", "a", "b", "a"] and analysis.spread_tasks([], 1) == [analysis.DEFAULT_TASKS[0]] and analysis.spread_tasks(["a"], 0) == []


def test_personas():
    seen = [{"title": "t", "excerpt": "e"}]
    with pytest.raises(ValueError):
        analysis.personas_of({"personas": {}}, 2)
    assert [p.name for p in analysis.personas_of({"personas": [person("a"), person("A"), 3, person("b"), person("c")]}, 2)] == ["a", "b"]
    one = Says({"personas": [person("a")]})
    assert [p.name for p in analysis.infer_personas(one, [seen * 9], 2, with_builtins=False)] == ["a"] and len(one.asked) == 1
    three = Says({"personas": [person("a")]}, {"personas": [person("b")]}, {"personas": [person(x) for x in "abc"]})
    assert [p.name for p in analysis.infer_personas(three, [seen * 2, seen * 2], 3, with_builtins=False)] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        analysis.infer_personas(Says({"personas": [person("a")]}, {"personas": [person("a")]}), [seen * 3], 3)
    got = analysis.expanded(Says({"personas": [person("nurse"), person("other")]}), ["Doctor!", "nurse", "doctor", "clerk"], seen)
    assert [p.name for p in got] == ["nurse", "nurse", "other"]  # a name that the model left out takes its first persona that is free yet
    assert [p.name for p in analysis.expanded(Says({"personas": []}), ["clerk"], seen)] == ["clerk"]
    # A failing model leaves personas from the profile, then the built-in ones.
    profile = analysis.Profile.of(GOOD)
    kept = analysis.default_personas(Says(RuntimeError("x"), {"personas": [person("a"), person("needle"), person("b"), person("c")]}), [seen], profile)
    assert [p.name for p in kept] == [*rounds.BUILTIN, "a"] or [p.name for p in kept] == [*rounds.BUILTIN, "a", "b"]
    assert [p.name for p in analysis.default_personas(Says(RuntimeError("x"), RuntimeError("y")), [seen], profile)] == list(rounds.BUILTIN)
    asked = analysis.resolved(Says({"personas": [person("clerk")]}), ["clerk", "Summarizer", "clerk"], [seen])
    assert [p.name for p in asked] == ["clerk", "summarizer"]
    assert {p.level for p in analysis.with_level(asked, "line")} == {"line"}
    with pytest.raises(ValueError):
        analysis.with_level(asked, "word")


def test_skim(spark):
    page = "The engine draws its water from the upper tank through two pipes that run along the northern wall. " * 4
    rows = [(i, f"t{i}", "\f".join(f"Page {k} of {i}. {page}" for k in range(12)) if i % 2 else page * (i + 1)) for i in range(12)] + [(99, "empty", ""), (98, "null", None)]
    d = spark.createDataFrame(rows, "doc_id int, title string, text string")
    got = analysis.skim(d).collect()
    assert len(got) == 4 and all(0 < len(r.excerpt) <= 900 + 200 + 18 for r in got)
    assert sorted(map(tuple, analysis.skim(d.repartition(5)).collect())) == sorted(map(tuple, got))
    assert not any("Page 0 of" in r.excerpt for r in got)
    assert analysis.skim(d.where("doc_id >= 98")).count() == 0


def test_summaries(spark):
    d = spark.createDataFrame([(1, 0, "One part."), (1, 1, "Another part."), (2, 0, " ")], "doc_id int, section_id int, text string")
    assert [tuple(r) for r in analysis.summaries(d, Stub).collect()] == [(1, "One part. Another part.", None)]

    class Blank:  # defined here, so that it travels to the workers
        def generate_json(self, *_, **__):
            return {"summary": " "}

    bad = analysis.summaries(d, Blank).collect()
    assert bad[0].summary is None and "ValueError" in bad[0].error
    long = "x" * 100_000
    assert len(analysis.summary_source(long, 2_000)) == 8_000 and len(analysis.summary_source(long, 3_000, lambda t: len(t) // 2)) < 7_000 and analysis.summary_source("abc", 9, len) == "abc"


def test_factory(monkeypatch):
    assert factory() is Stub
    with pytest.raises(ValueError):
        factory("http://x", "m", "NO_SUCH_KEY")
    monkeypatch.setenv("SOME_KEY", "k")
    assert factory("http://x", "m", "SOME_KEY", {"m": "vendor/m"})().model_name == "vendor/m"


def test_loading(spark, tmp_path):
    (tmp_path / "own" / "data").mkdir(parents=True)
    text = "A sentence that is long enough to be a text of a row in a file, as all of them are here. "
    for i in range(5):
        (tmp_path / "own" / f"f{i}.txt").write_text(f"{i} {text}")
    (tmp_path / "own" / "rows.jsonl").write_text("\n".join(f'{{"id": "r{i}", "text": "{i} {text}"}}' for i in range(40)))
    (tmp_path / "own" / "note.bin").write_text("x")
    base = f"file://{tmp_path}"
    every = loading.load(spark, f"{base}/own")
    assert every.columns == loading.COLUMNS and every.count() == 45
    some = [r.doc_id for r in loading.load(spark, f"{base}/own", limit=7, seed=3).collect()]
    assert len(some) == 7 and some == [r.doc_id for r in loading.load(spark, f"{base}/own", limit=7, seed=3).collect()]
    assert loading.load(spark, f"{base}/own/rows.jsonl", limit=5).count() == 5
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", f"in the archive {text}")
        z.writestr("in/rows.csv", f'id,text\nc1,"{text}"\nc2,"{text}"\n')
        z.writestr("in/rows.json", f'{{"data": [{{"id": "j1", "text": "{text}"}}]}}')
    assert {r.doc_id for r in loading.load(spark, f"{base}/z.zip").collect()} == {"a.txt", "c1", "c2", "j1"}
    assert loading.load(spark, "own/data", mirror=base) if (tmp_path / "own" / "data" / "x.jsonl").write_text('{"id": "d", "text": "%s"}' % text) else None
    assert loading.load_all(spark, [f"{base}/own/f0.txt", f"{base}/own/f1.txt", f"{base}/own/f0.txt"]).count() == 2
    for bad in ([], [f"{base}/own/f0.txt"] * 1 + ["own/data"], [f"{base}/own/f{i}.txt?{i}" for i in range(51)]):
        with pytest.raises((readers.SourceError, ValueError)):
            loading.load_all(spark, bad, mirror=base)
    with pytest.raises(readers.SourceError):
        loading.load_all(spark, [f"{base}/own/f0.txt"], most=10)
    with pytest.raises(readers.SourceError):
        loading.load(spark, f"{base}/own/none")


def test_downloads(tmp_path):
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"" if "empty" in self.path else b"x" * 2000
            self.send_response(200)
            if "told" in self.path:
                self.send_header("Content-Length", str(len(body)))
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        path = loading.download(f"{base}/page?x=1", str(tmp_path))
        assert path.endswith("page.html") and len(open(path).read()) == 2000
        for bad in ("told", "untold"):
            with pytest.raises(readers.SourceError, match="more than"):
                loading.download(f"{base}/{bad}", str(tmp_path), most=1000)
        with pytest.raises(readers.SourceError, match="empty"):
            loading.download(f"{base}/empty.txt", str(tmp_path))
    finally:
        server.shutdown()


def test_paged_files(spark, tmp_path):
    for n in ("dense", "sparse", "bare"):
        (tmp_path / f"{n}.pdf").write_bytes(n.encode())

    def native(raw):
        return {b"dense": ("\f".join(["words of a page that are many enough to count as text"] * 3), 3), b"sparse": ("x", 40), b"bare": ("few", 2)}[raw]

    def ocr(raw, pages):
        return [f"{raw.decode()} page {p}" if raw != b"bare" else "" for p in pages]

    got = {r.title: r for r in readers.document_files(spark, f"file://{tmp_path}", ocr=ocr, native=native).collect()}
    assert got["sparse"].text.split("\f") == [f"sparse page {p}" for p in range(1, 41)] and got["bare"].text == "few" and got["dense"].page_count == 3
    some = {r.title: r for r in readers.document_files(spark, f"file://{tmp_path}", ocr=ocr, native=native, ocr_limit=4).collect()}
    assert len(some["sparse"].text.split("\f")) == 4 and some["sparse"].capacity_chars == int((len(some["sparse"].text) - 3) * 10)


def test_remaining(spark):
    pool = spark.createDataFrame([(d, p) for d in range(4) for p in ("a", "b")], "doc_id int, persona string")
    done = spark.createDataFrame([(0, "A"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "doc_id int, persona string")
    got = sorted(map(tuple, job.remaining(pool, done, 3).collect()))
    assert got == [(0, "b"), (1, "a"), (1, "b"), (3, "a"), (3, "b")]


def test_rows_keep_their_own_pages(spark):
    contents = "\n".join(f"Part {i} ..... {i}" for i in range(9))
    prose = [f"The engine {v} its water from the upper tank through two pipes that run along the northern wall of the hall." for v in ("draws", "takes", "gets", "has")]
    rows = [(1, f"{prose[0]}\f{contents}\f{prose[1]}", "x"), (1, f"{prose[2]}\f{prose[3]}", "y"), (None, f"{contents}\f{contents}", "z"), (2, "no pages", "w"), (3, None, "v")]
    got = clean.drop_pages(spark.createDataFrame(rows, "doc_id int, t string, o string"), "t").collect()
    assert {r.o: r.t for r in got} == {"x": f"{prose[0]}\f{prose[1]}", "y": rows[1][1], "z": "", "w": "no pages", "v": None} and len(got) == 5


def test_made_ids_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([("same text",)] * 3 + [(f"text {i}",) for i in range(20)], "text string")
    schema = {"text_column": "text", "id_column": None, "title_column": None, "metadata_columns": []}
    runs = [sorted(r.doc_id for r in discover.documents(d.repartition(n), schema, "s").collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and len(set(runs[0])) == 23
