"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from textloom import plans


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


FAST = ["text_clean", "document_gates", "line_gates", "section_parse", "sentence_split", "text_scalars", "chunks_line", "chunks_section", "pair_gates", "instruction_keys", "near_first", "transcripts", "column_pairs", "text_columns", "id_columns",
        "nested_text", "corpus_capacity", "overlap_join", "work_queue", "augmentation", "page_sample", "resume", "citations", "unique_errors", "latest_status",
        "chunks_paragraph", "chunks_page", "claims", "anchor_projection", "shared_work", "analysis_sample", "read_jsonl", "read_csv", "dense_pages", "source_sizes", "detected", "lookup_contexts", "reference_blocks",
        "task_labels", "document_summaries", "model_answers"]


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == expected


def test_every_query_is_known():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_model_answers_of_odd_texts(spark, tmp_path):
    texts = [None, "", "a", " ", "ab", "one,ab", "one,  ab", "key:ab", "nbsp\xa0ab", "line\u2028ab", "😀😀", "x😀a", 'say "x"', 'a"b', "a\\b", "a\\\\b", "ends\n", "tab\tb", "control\x01b", "xy\\u12",
             "use ```ab", "a <think>b</think> c", "a <think>b", "<thinking>x</thinking>ab", '"}, ab', '{"a": 1', "[1,ab"]
    spark.createDataFrame([(i, turn, x) for i, x in enumerate(texts) for turn in range(-2, 3)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(plans.ORACLES["model_answers"]).fetchall()
    got = plans.QUERIES["model_answers"](spark, str(tmp_path)).select("conv_id", "turn", "output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_model_answers_of_a_long_text(spark, tmp_path):
    rows = spark.range(3).selectExpr("id as conv_id", "id as turn", "repeat('word, ', 3500000) as text")  # more than Spark's own readers of JSON take
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = plans.QUERIES["model_answers"](spark, str(tmp_path)).selectExpr("turn", "length(output)", "right(output, 6)").collect()
    assert sorted(map(tuple, got)) == [(0, 21_000_000, "word, "), (1, 21_000_000, "word, "), (2, 20_999_998, ", word")]
