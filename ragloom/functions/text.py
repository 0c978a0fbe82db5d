"""Column functions on text: sentences, tokens, answer checks."""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations, stopwords and phrases that results depend on.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Inc", "Ltd", "Corp", "vs", "etc")
JUDGE_ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "Inc.", "Ltd.", "Corp.", "vs.", "etc.", "e.g.", "i.e.", "U.S.", "U.K.", "E.U.", "No.", "Vol.", "Fig.")
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they",
)
REJECTION_PHRASES = (
    "i can not answer", "i cannot answer", "cannot answer", "can't answer", "insufficient information", "not enough information",
    "no relevant information", "documents do not contain", "unable to answer", "don't have enough", "do not have enough",
)
ERROR_PHRASES = (
    "factual error", "factual errors", "incorrect information", "wrong information", "inaccurate", "not accurate", "error in the document", "inconsistencies", "contradicts",
)

_DOT = "\x01"  # stands for a protected full stop


def plain_sentence(piece: Column) -> Column:
    """A piece with its full stops back, trimmed."""
    return F.regexp_replace(F.replace(piece, F.lit(_DOT), F.lit(".")), r"^\s+|\s+$", "")


def _restored(parts: Column) -> Column:
    return F.filter(F.transform(parts, plain_sentence), lambda s: s != "")


def sentence_pieces(text: Column) -> Column:
    """What a text is cut into after full stops, question and exclamation marks that blanks follow, untrimmed; see plain_sentence()."""
    guarded = F.regexp_replace(text, rf"\b({'|'.join(ABBREVIATIONS)})\.\s", f"$1{_DOT} ")
    return F.split(guarded, r"(?<=[.!?])\s+")


def sentences(text: Column) -> Column:
    """Sentences of a text; a full stop after a common abbreviation and a blank ends none. Null for null."""
    return _restored(sentence_pieces(text))


def judge_sentences(text: Column) -> Column:
    """Sentences as the judge counts them: abbreviations are protected wherever their letters stand; a text that isn't blank has one at least."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    guarded = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", _DOT))), JUDGE_ABBREVIATIONS, plain)
    parts = _restored(F.split(guarded, r"(?<=[.!?])\s+"))
    return F.when(plain == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(plain)).otherwise(parts)


def letter(at: Column) -> Column:
    """The character `at` places after a: letters first, then whatever follows by code point, so that no two places share one."""
    return F.decode(F.unhex(F.lpad(F.hex((at + 97).cast("long")), 8, "0")), "UTF-32")


def keyed_documents(documents: Column) -> Column:
    """Lines "0a. sentence" of all sentences of an array of documents."""
    lines = F.transform(documents, lambda d, i: F.transform(judge_sentences(d), lambda s, j: F.concat(i.cast("string"), letter(j), F.lit(". "), s)))
    return F.array_join(F.flatten(lines), "\n")


def n_sentences(documents: Column) -> Column:
    """Sentences of an array of documents in all, as the judge counts them."""
    return F.aggregate(F.transform(documents, lambda d: F.size(judge_sentences(d))), F.lit(0), lambda a, x: a + x)


def keyed_response(response: Column) -> Column:
    """Lines "a. sentence" of a response."""
    return F.array_join(F.transform(judge_sentences(response), lambda s, j: F.concat(letter(j), F.lit(". "), s)), "\n")


def content_tokens(text: Column) -> Column:
    """Lower-case tokens of a-z and 0-9 with three letters or more that are no stopwords."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: t.rlike("^[a-z0-9]+$") & (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def blank_tokens(text: Column) -> Column:
    """Lower-case tokens between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def _nfkc(texts: Column) -> Column:
    """The compatibility form of an array of texts."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in r] for r in rows], dtype=object)

    return run(texts)


# What normalising an answer replaces, in this order.
REPLACED = (
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
    ("[–—−]", "-"), ('["„]', '"'), ("['`]", "'"), (r"\s+", " "),
)


def _plain(text: Column) -> Column:
    for pattern, to in REPLACED:
        text = F.regexp_replace(text, pattern, to)
    return F.btrim(text)


def normalized_answers(texts: Column, ascii_only: bool = False) -> Column:
    """Array of texts in lower case, compatibility form, without markdown emphasis, plain dashes and quotes, single blanks.

    ascii_only leaves out the compatibility form, the one step that SQL lacks; it changes nothing in ASCII text.
    """
    low = F.transform(texts, lambda t: F.lower(t))
    return F.transform(low if ascii_only else _nfkc(low), _plain)


def normalized_answer(text: Column, ascii_only: bool = False) -> Column:
    return F.element_at(normalized_answers(F.array(text), ascii_only), 1)


#: A text or another value without parts in JSON; brackets, commas and blanks are between them.
_LEAF = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{},:"\s]++'


def flat_answers(answers: Column) -> Column:
    """The texts of a VARIANT that is a text or lists of texts, nested to any depth, in order; numbers and truth values as texts.

    A null in a list is the text "None"; null and empty lists have no texts.
    """
    leaves = F.regexp_extract_all(F.to_json(answers), F.lit(_LEAF), F.lit(0))
    # a leaf is unescaped by reading it as JSON
    texts = F.transform(leaves, lambda x: F.when(x == "null", "None").otherwise(F.try_variant_get(F.try_parse_json(x), "$", "string")))
    none = F.array().cast("array<string>")
    return F.when(F.is_variant_null(answers) | answers.isNull(), none).otherwise(F.coalesce(texts, none))


def contains_answer(response: Column, answers: Column, ascii_only: bool = False) -> Column:
    """Whether any of the array of answers is in the response, both normalised."""
    every = normalized_answers(F.concat(F.array(response), answers), ascii_only)
    found = F.transform(F.array(every), lambda x: F.exists(F.slice(x, F.lit(2), F.size(x)), lambda a: F.contains(x[0], a)))
    return F.element_at(found, 1)


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(F.lower(text), F.lit(p)) for p in phrases))


def is_rejection(response: Column) -> Column:
    return has_phrase(response, REJECTION_PHRASES)


def detects_error(response: Column) -> Column:
    return has_phrase(response, ERROR_PHRASES)


def without_reasoning(text: Column) -> Column:
    """Text without think, thinking, reasoning and reflection blocks, at most one empty line in a row, trimmed."""
    for tag in ("think", "thinking", "reasoning", "reflection"):
        text = F.regexp_replace(text, rf"(?is)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
