import json
import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import judge_json, prompts, text
from ragloom.functions.metrics import cosine, trace_average, trace_scores


def value(spark, column, **columns):
    """A column expression's value on one row."""
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Dr. Smith met Acme Inc. today. It went well! Really?", ["Dr. Smith met Acme Inc. today.", "It went well!", "Really?"]),
        ("Revenue was $5.2 billion. Up 3%.", ["Revenue was $5.2 billion.", "Up 3%."]),
        ("  \n ", []),
        ("", []),
    ],
)
def test_sentences(spark, said, want):
    assert value(spark, text.sentences(F.col("t")), t=said) == want


def test_judge_sentences(spark):
    assert value(spark, text.judge_sentences(F.col("t")), t="Yes or No. Then more.") == ["Yes or No. Then more."]
    assert value(spark, text.sentences(F.col("t")), t="Yes or No. Then more.") == ["Yes or No.", "Then more."]
    assert value(spark, text.judge_sentences(F.lit(None).cast("string"))) == []


def test_keys(spark):
    docs = F.array(F.lit("One. Two."), F.lit("Three."))
    assert value(spark, text.keyed_documents(docs)) == "0a. One.\n0b. Two.\n1a. Three."
    assert value(spark, text.keyed_response(F.lit("One. Two."))) == "a. One.\nb. Two."


def test_tokens(spark):
    assert value(spark, text.content_tokens(F.lit("The ROI of AI in 2023 is 12"))) == ["roi", "2023"]
    assert value(spark, text.blank_tokens(F.lit(" A  b, C"))) == ["a", "b,", "c"]


def test_answers(spark):
    assert value(spark, text.contains_answer(F.lit("**Paris** — France"), F.array(F.lit("paris"), F.lit("lyon"))))
    assert value(spark, text.normalized_answer(F.lit("Ｆｏｏ  __bar__"))) == "foo bar"
    assert value(spark, text.is_rejection(F.lit("I cannot answer this.")))
    assert not value(spark, text.detects_error(F.lit("All fine.")))
    assert value(spark, text.without_reasoning(F.lit("<think>a\nb</THINK> yes\n\n\n\nno"))) == "yes\n\nno"


def scan(s):
    out, i = "", 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s):
            out += s[i : i + 2] if s[i + 1] in 'nrtbf"\\/u' else s[i + 1]
            i += 2
        else:
            out += s[i]
            i += 1
    return out


def test_escapes_equal_a_scan(spark):
    r = random.Random(0)
    cases = ["".join(r.choice("\\\\nq\"'u/ \n") for _ in range(r.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", judge_json.repaired_escapes(F.col("t")).alias("v")).collect()
    assert all(g.v == scan(g.t) for g in got)


@pytest.mark.parametrize("around", ["{}", "```json\n{}\n```", "Sure: {} Bye", "```{}```"])
def test_judgement(spark, around):
    said = json.dumps({"all_relevant_sentence_keys": ["0a", "0b"], "overall_supported": True, "all_utilized_sentence_keys": ["0b"]})
    got = value(spark, judge_json.parsed_judgement(F.col("t")), t=around.replace("{}", said))
    assert got.all_relevant_sentence_keys == ["0a", "0b"] and got.overall_supported and got.all_utilized_sentence_keys == ["0b"]


def test_judgement_broken(spark):
    got = value(spark, judge_json.parsed_judgement(F.col("t")), t='{"all_relevant_sentence_keys": ["0a", "x"], "overall_supported":true, broken')
    assert got.all_relevant_sentence_keys == ["0a"] and got.overall_supported
    got = value(spark, judge_json.parsed_judgement(F.lit("")))
    assert not got.overall_supported and got.all_relevant_sentence_keys == []


def test_trace(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    s = value(spark, trace_scores(arr("0a", "0b"), arr("0b", "0c"), F.lit(True), F.lit(4)))
    assert tuple(s) == (0.5, 0.5, 0.5, 1.0)
    assert tuple(value(spark, trace_scores(arr("0a"), arr(), F.lit(True), F.lit(0)))) == (0.0, 0.0, 0.0, 1.0)
    assert value(spark, trace_scores(arr("0a", "0b"), arr(), F.lit(False), F.lit(1))).context_relevance == 1.0
    assert value(spark, trace_average(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))) == 0.25


def test_prompts(spark):
    chunk = F.struct(F.lit("text").alias("text"), F.lit(0.856).alias("score"))
    assert value(spark, prompts.ranked_context(F.array(chunk))) == "[Document 1] (relevance: 0.86)\ntext"
    assert value(spark, prompts.ranked_context(F.filter(F.array(chunk), lambda c: F.lit(False)))) == prompts.NO_CONTEXT
    assert value(spark, prompts.joined_context(F.array().cast("array<string>"), F.lit("abc"), 2)) == "ab"


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, cosine(v(1.0, 0.0), v(0.0, 2.0))) == 0.0
    assert value(spark, cosine(v(3.0, 4.0), v(3.0, 4.0))) == pytest.approx(1.0)
    assert value(spark, cosine(v(0.0, 0.0), v(3.0, 4.0))) == 0.0


def test_letters_stay_apart_beyond_the_alphabet(spark):
    from ragloom.functions.text import letter

    got = [r.c for r in spark.range(400).select(letter(F.col("id")).alias("c")).collect()]
    assert got == [chr(97 + i) for i in range(400)]


def test_fields_hold_something_by_kind(spark):
    from ragloom.sources.loaders import adherence_of, field

    rows = ['{"id": "0", "question": "false"}', '{"id": 0, "idx": 7, "query": "q"}', '{"id": "", "example_id": "e"}', '{"id": null, "idx": [], "example_id": false}', '{"id": 0.0, "idx": {}, "example_id": 1.5}']
    frame = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("r"))
    assert [tuple(r) for r in frame.select(field(F.col("r"), ("id", "idx", "example_id")), field(F.col("r"), ("question", "query"))).collect()] == [("0", "false"), ("7", "q"), ("e", None), (None, None), ("1.5", None)]
    rows = ['{"adherence_score": 0.0}', '{"faithfulness": "no"}', '{"adherence": null, "faithfulness": 0}', '{"adherence": true}', '{"adherence": "YES"}', "{}", '{"adherence": [1]}', '{"adherence": 0.25, "adherence_score": 1}']
    frame = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("r"))
    assert [r[0] for r in frame.select(adherence_of(F.col("r"))).collect()] == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.25]


def test_line_numbers_over_parts_of_a_file(spark, tmp_path):
    from ragloom.sources.loaders import load_json_lines

    lines = [f'{{"n": {i}}}' if i % 7 else " " for i in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = load_json_lines(spark, str(tmp_path / "a.json"), with_line=True)
        got = sorted((r.id, r.n) for r in rows.select("id", F.variant_get("record", "$.n", "int").alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, i) for i in range(500) if i % 7]
