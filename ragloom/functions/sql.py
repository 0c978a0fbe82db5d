"""The library in Spark SQL: scalar functions of texts and scores, and table functions that cut documents.

register(spark) adds to the session

    content_tokens(text), blank_tokens(text), text_sentences(text), judge_text_sentences(text), is_rejection(text), detects_error(text),
    without_reasoning(text), vector_cosine(a, b), trace_scores(relevant, utilized, supported, total)

as SQL functions, which Spark inlines, and

    whole_chunks(TABLE(docs)), sentence_chunks(TABLE(docs), size, overlap), semantic_chunks(TABLE(docs), threshold)

as table functions. docs needs doc_id and text; its other columns are carried to every chunk. With PARTITION BY example_id ORDER BY (doc_id), chunks are
numbered through each example (global_chunk_id); without, through the rows of a task.
"""

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ragloom.functions import text as T
from ragloom.operators.chunking import greedy_bounds, similarities
from ragloom.operators.embedding import HashingEmbedder

_CHUNK = [StructField("chunk_id", IntegerType()), StructField("global_chunk_id", LongType()), StructField("start_sentence", IntegerType()), StructField("end_sentence", IntegerType()), StructField("text", StringType())]
#: What Spark's patterns mean by white space, which is less than Python's.
_BLANKS = " \t\n\x0b\x0c\r"
_GUARD = re.compile(rf"\b({'|'.join(T.ABBREVIATIONS)})\.[{_BLANKS}]")
_CUT, _DOT = re.compile(rf"(?<=[.!?])[{_BLANKS}]+"), "\x01"


def split_sentences(text: str | None) -> list[str]:
    """functions.text.sentences of one text."""
    if text is None:
        return []
    parts = _CUT.split(_GUARD.sub(rf"\1{_DOT} ", text))
    return [s for p in parts if (s := p.replace(_DOT, ".").strip(_BLANKS))]


class _Chunker:
    """What the table functions share: columns are carried on, and chunks are numbered as rows come."""

    @staticmethod
    def columns(docs: AnalyzeArgument) -> AnalyzeResult:
        if not docs.isTable or not {"doc_id", "text"} <= set(docs.dataType.names):
            raise ValueError("give a TABLE with the columns doc_id and text")
        return AnalyzeResult(StructType([f for f in docs.dataType.fields if f.name not in ("text", *(c.name for c in _CHUNK))] + _CHUNK))

    def __init__(self):
        self.number = 0

    def bounds(self, parts: list[str]) -> list[tuple[int, int]]:
        raise NotImplementedError

    def rows(self, row) -> Iterator[tuple]:
        parts = split_sentences(row["text"])
        carried = tuple(v for c, v in row.asDict().items() if c not in ("text", *(f.name for f in _CHUNK)))
        for at, (a, b) in enumerate(self.bounds(parts) if parts else []):
            yield (*carried, at, self.number, a, b, " ".join(parts[a : b + 1]))
            self.number += 1


@udtf
class WholeChunks(_Chunker):
    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        return _Chunker.columns(docs)

    def eval(self, docs) -> Iterator[tuple]:
        if docs["text"] is not None and docs["text"].strip(_BLANKS):
            carried = tuple(v for c, v in docs.asDict().items() if c not in ("text", *(f.name for f in _CHUNK)))
            yield (*carried, 0, self.number, None, None, docs["text"])
            self.number += 1


@udtf
class SentenceChunks(_Chunker):
    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        return _Chunker.columns(docs)

    def eval(self, docs, size: int, overlap: int) -> Iterator[tuple]:
        self.size, self.step = size, max(1, size - overlap)
        yield from self.rows(docs)

    def bounds(self, parts: list[str]) -> list[tuple[int, int]]:
        n = len(parts)
        windows = 1 if n <= self.size else -(-(n - self.size) // self.step) + 1
        return [(k * self.step, min(k * self.step + self.size, n) - 1) for k in range(windows)]


@udtf
class SemanticChunks(_Chunker):
    @staticmethod
    def analyze(docs: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        return _Chunker.columns(docs)

    def __init__(self):
        super().__init__()
        self.embedder = HashingEmbedder()

    def eval(self, docs, threshold: float) -> Iterator[tuple]:
        self.threshold = float(threshold)
        yield from self.rows(docs)

    def bounds(self, parts: list[str]) -> list[tuple[int, int]]:
        if len(parts) <= 2:
            return [(0, len(parts) - 1)]
        return greedy_bounds(np.round(similarities(self.embedder.embed(parts)), 6), self.threshold, 2, 10)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _restored(parts: str) -> str:
    return f"filter(transform({parts}, s -> regexp_replace(replace(s, char(1), '.'), {_quoted(r'^\s+|\s+$')}, '')), s -> s <> '')"


def _functions() -> dict[str, str]:
    """Name and parameters to type and body."""
    cut = _quoted(r"(?<=[.!?])\s+")
    guard = _quoted(rf"\b({'|'.join(T.ABBREVIATIONS)})\.\s")
    guarded = f"regexp_replace(text, {guard}, concat('$1', char(1), ' '))"
    judged = f"regexp_replace(coalesce(text, ''), {_quoted(r'^\s+|\s+$')}, '')"
    plain = judged
    for a in T.JUDGE_ABBREVIATIONS:
        judged = f"replace({judged}, {_quoted(a)}, replace({_quoted(a)}, '.', char(1)))"
    listed = lambda words: ", ".join(map(_quoted, words))
    holds = lambda phrases: " OR ".join(f"contains(lower(text), {_quoted(p)})" for p in phrases)
    bare = "text"
    for tag in ("think", "thinking", "reasoning", "reflection"):
        bare = f"regexp_replace({bare}, {_quoted(f'(?is)<{tag}>.*?</{tag}>')}, '')"
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    share = lambda n, d: f"CASE WHEN total > 0 AND {d} > 0 THEN least(double({n}) / greatest({d}, 1), 1D) ELSE 0D END"
    r, u = "size(array_distinct(relevant))", "size(array_distinct(utilized))"
    both = "size(array_intersect(array_distinct(relevant), array_distinct(utilized)))"
    return {
        "content_tokens(text STRING)": ("ARRAY<STRING>", f"filter(split(lower(text), {_quoted(r'[^\p{L}\p{N}_]+')}), t -> t RLIKE '^[a-z0-9]+$' AND length(t) > 2 AND t NOT IN ({listed(T.STOPWORDS)}))"),
        "blank_tokens(text STRING)": ("ARRAY<STRING>", f"filter(split(lower(text), {_quoted(r'\s+')}), t -> t <> '')"),
        "text_sentences(text STRING)": ("ARRAY<STRING>", _restored(f"split({guarded}, {cut})")),
        "judge_text_sentences(text STRING)": ("ARRAY<STRING>", f"CASE WHEN {plain} = '' THEN array() WHEN size({_restored(f'split({judged}, {cut})')}) = 0 THEN array({plain}) ELSE {_restored(f'split({judged}, {cut})')} END"),
        "is_rejection(text STRING)": ("BOOLEAN", holds(T.REJECTION_PHRASES)),
        "detects_error(text STRING)": ("BOOLEAN", holds(T.ERROR_PHRASES)),
        "without_reasoning(text STRING)": ("STRING", f"regexp_replace(regexp_replace({bare}, {_quoted(chr(92) + 'n{3,}')}, concat(char(10), char(10))), {_quoted(r'^\s+|\s+$')}, '')"),
        "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", f"CASE WHEN sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')}) > 0 THEN {dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})) ELSE 0D END"),
        "trace_scores(relevant ARRAY<STRING>, utilized ARRAY<STRING>, supported BOOLEAN, total INT)": (
            "STRUCT<context_relevance: DOUBLE, context_utilization: DOUBLE, completeness: DOUBLE, adherence: DOUBLE>",
            f"named_struct('context_relevance', {share(r, 'total')}, 'context_utilization', {share(u, 'total')}, 'completeness', {share(both, r)}, 'adherence', double(supported))",
        ),
    }


def register(spark: SparkSession) -> None:
    """Add the functions to the session; a second call changes nothing."""
    for name, (kind, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    for name, function in {"whole_chunks": WholeChunks, "sentence_chunks": SentenceChunks, "semantic_chunks": SemanticChunks}.items():
        spark.udtf.register(name, function)
