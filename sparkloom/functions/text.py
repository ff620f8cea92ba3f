"""Expressions on texts: normal forms, identifiers, redaction, measures, features."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

#: Half-open spans of characters.
SPANS = types.ArrayType(types.StructType([types.StructField("start", types.IntegerType()), types.StructField("end", types.IntegerType())]))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalize_doi(text: Column) -> Column:
    """Lower case without resolver or scheme; null if it isn't a DOI."""
    doi = F.regexp_replace(F.lower(F.trim(text)), r"^(https://doi\.org/|http://doi\.org/|doi:)", "")
    return F.when(doi.rlike(r"^10\.[^\s]*/[^\s]*$"), F.regexp_replace(doi, r"[. ]+$", ""))


def dois(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(10\.[0-9]{4,9}/[-._;()/:a-z0-9]+)"), 1), lambda x: F.regexp_replace(x, r"[.,;:]+$", "")))


# What a key may look like.
KEY_VALUE = r"(?i)(api[_-]?key|authorization|x-api-key|x-goog-api-key)(\s*[:=]\s*)([^\s,}\]]+)"
BEARER = r"(?i)(bearer)(\s+)([^\s,}\]]+)"
SECRET_KEYS = (r"\bsk-[A-Za-z0-9_-]{8,}\b", r"\bAIza[A-Za-z0-9_-]{20,}\b")


def redact(text: Column) -> Column:
    """Values of keys are masked, keys stay."""
    for pattern in (KEY_VALUE, BEARER):
        text = F.regexp_replace(text, pattern, "$1$2[REDACTED]")
    for pattern in SECRET_KEYS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def wide_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def estimated_tokens(characters: Column, wide: Column) -> Column:
    return F.floor((characters - wide) / 4 + wide / 1.5).cast("long")


def budgeted(text: Column, budget: int) -> Column:
    """The text if it fits; else six tenths of the budget from its head and the rest from its tail."""
    head = budget * 6 // 10
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n"), F.right(text, F.lit(budget - head))))


# Headings of reference lists, the least text and the mark of what is left out.
REFERENCES = r"[^\S\n]{0,60}(?:\d+[.)]?[^\S\n]{1,6})?(?:references|bibliography|literature cited|works cited)[^\S\n]*:?[^\S\n]*$"
LEAST_TEXT = 1000
ELISION = "\n\n[... middle of the article omitted by the prescreen budget ...]\n\n"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def references_start(text: Column) -> Column:
    """Where the last heading of a reference list in the second half begins; the length of the text if there is none."""
    found = F.length(F.regexp_extract(text, rf"(?imsdU)\A(.*)^{REFERENCES}", 1))
    late = lambda at: F.when((at > 0) & (at >= F.floor(F.length(text) / 2)), at).otherwise(F.length(text))
    return once(found, late).cast("int")


def state_text(text: Column, tokens: int) -> Column:
    """What of a text fits a budget of tokens, and by which rule: all of it, all before the references, or six tenths of
    the budget from the head of that and the rest from its tail. The budget is turned into characters by the script
    mix of the text. Null for null."""
    row = lambda rule, state: F.struct(rule.alias("rule"), state.alias("state"))
    estimate = estimated_tokens(F.length(text), wide_characters(text))
    budget = once(estimate, lambda e: F.greatest(F.lit(LEAST_TEXT), F.floor(tokens * F.when(e > 0, F.length(text) / e).otherwise(4.0)).cast("int")))

    def ends(size: Column, end: Column) -> Column:
        head = F.floor(size * 6 / 10).cast("int")
        tail = size - head
        rule = F.when(end == F.length(text), "head_tail").otherwise("references_trimmed_head_tail")
        cut = F.concat(F.substring(text, F.lit(1), head), F.lit(ELISION), F.substring(text, end - tail + 1, tail))
        return F.when(end <= size, row(F.lit("references_trimmed"), F.substring(text, F.lit(1), end))).otherwise(row(rule, cut))

    cut = lambda size: once(references_start(text), lambda end: ends(size, end))
    fitted = once(budget, lambda size: F.when(F.length(text) <= size, row(F.lit("whole"), text)).otherwise(cut(size)))
    return F.when(text.isNotNull(), fitted)


def script(text: Column) -> Column:
    cyrillic, latin = text.rlike(r"\p{IsCyrillic}"), text.rlike(r"[A-Za-z]")
    return F.when(cyrillic & latin, "mixed").when(cyrillic, "cyrillic").otherwise("latin")


def line_measures(text: Column) -> dict[str, Column]:
    """Lines, blank ones, short ones, and those that break within a word."""
    lines = F.split(text, "\n", -1)
    return {
        "n_lines": F.size(lines).cast("long"),
        "blank": F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long"),
        "short": F.size(F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 40))).cast("long"),
        "broken": F.size(F.filter(lines, lambda x: x.rlike(r"[a-z]-$"))).cast("long"),
    }


# Glued columns, words cut by a line's end, ligatures and soft hyphens.
GUTTER = r"[A-Za-z,.;:)][ ]{3,}[A-Za-z(]"
MID_WORD_BREAK = r"[\p{L}\p{N}&&[^\p{Nd}]][-\x{2010}\x{00AD}]\n[a-z]"
PRESENTATION = r"[\x{FB00}-\x{FB06}\x{00AD}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def extraction_measures(text: Column) -> dict[str, Column]:
    """Defects of an extracted text: glued columns among its lines that aren't blank, cut words, presentation marks."""
    lines = F.filter(F.split(text, LINE_END, -1), lambda x: x.rlike(r"(?U)\S"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return {
        "lines": F.size(lines).cast("long"),
        "gutter_lines": F.size(F.filter(lines, lambda x: x.rlike(GUTTER))).cast("long"),
        "mid_word_breaks": count(MID_WORD_BREAK),
        "presentation_marks": count(PRESENTATION),
        "characters": F.length(text).cast("long"),
        "words": count(r"(?U)\S+"),
    }


def segments(text: Column, size: int) -> Column:
    """Pieces of a fixed number of characters, with their start."""
    last = F.greatest(F.length(text) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size)), lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("piece")))


def years(text: Column) -> Column:
    """Calendar years, ranges of up to a century expanded."""
    ranges = F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2})-((?:19|20)[0-9]{2})"), 0)
    expand = F.flatten(F.transform(F.filter(ranges, lambda r: F.substring(r, 1, 4) <= F.substring(r, 6, 4)), lambda r: F.sequence(F.substring(r, 1, 4).cast("int"), F.substring(r, 6, 4).cast("int"))))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.array_union(expand, single)))


@F.pandas_udf(types.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition without soft hyphens; Spark has no function for it."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).replace("­", ""), na_action="ignore")


# What ends a sentence, what may close after it, and abbreviations whose full stop ends none.
SENTENCE_MARKS = re.compile("[.!?\u2026]+[\"'\u2019\u201d)\\]]*")
CLOSERS = ")]}\"'\u2019\u201d"
ABBREVIATIONS = frozenset(
    "al approx ca cf chap dr e.g ed eds eq eqs esp et etc fig figs i.e inc jr ltd max min mr mrs ms mt no nos p pp prof ref refs resp sec sr st suppl tab univ viz vol vs".split()
)
TOKEN_LETTERS = frozenset(".'-\u2019_")


def last_token(line: str, end: int) -> tuple[str, int]:
    """The token that ends before a place of a line, closers aside, and where it begins."""
    while end and line[end - 1] in CLOSERS:
        end -= 1
    start = end
    while start and (line[start - 1].isalnum() or line[start - 1] in TOKEN_LETTERS):
        start -= 1
    return line[start:end].rstrip("."), start


def ends_sentence(line: str, mark: int, after: int) -> bool:
    """Whether the mark at a place of a line, which closes before `after`, ends a sentence."""
    if after < len(line) and line[after] != " ":
        return False
    following = after
    while following < len(line) and line[following].isspace():
        following += 1
    if following < len(line) and line[following].islower():
        return False
    token, start = last_token(line, mark)
    if not token or len(token) == 1 and token.isalpha() or token.casefold() in ABBREVIATIONS:
        return False
    return not (token.isdigit() and not line[:start].strip())  # a number that opens a line is a marker


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open character spans of the sentences of a text; a line feed ends one. Time grows with the text's length."""
    spans, at = [], 0
    for line in text.split("\n"):
        begin, stops = 0, [m.end() for m in SENTENCE_MARKS.finditer(line) if ends_sentence(line, m.start(), m.end())]
        for stop in [*stops, len(line)]:
            own = line[begin:stop]
            if own.strip():
                spans.append((at + stop - len(own.lstrip()), at + begin + len(own.rstrip())))
            begin = stop
        at += len(line) + 1
    return spans


@F.pandas_udf(SPANS)
def sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t)] if t else [])


#: Sentences with their texts.
SENTENCES = types.ArrayType(types.StructType([types.StructField("start", types.IntegerType()), types.StructField("text", types.StringType())]))


@F.pandas_udf(SENTENCES)
def sentence_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As sentences, each cut out where its place is known: in Spark, a substring of UTF-8 is found from the text's begin."""
    for texts in batches:
        yield texts.map(lambda t: [{"start": a, "text": t[a:b]} for a, b in sentence_spans(t)] if t else [])


def pack_chunks(spans: list[tuple[int, int]], cap: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, characters carried over, complete) of chunks of whole sentences of at most cap characters, each of
    which repeats sentences of the one before until overlap characters are reached. A sentence longer than the cap is
    cut into pieces that are not complete."""
    if cap <= 0 or not 0 <= overlap < cap:
        raise ValueError("the cap must be positive and the overlap smaller")
    chunks: list[tuple[int, int, int, bool]] = []
    first = carried = 0
    while first < len(spans):
        start, end = spans[first]
        if end - start > cap:
            chunks += [(i, min(i + cap, end), 0, False) for i in range(start, end, cap)]
            first, carried = first + 1, 0
            continue
        after = first + 1
        while after < len(spans) and spans[after][1] - start <= cap:
            after += 1
        chunks.append((start, spans[after - 1][1], carried, True))
        if after == len(spans):
            break
        back, repeated = after, 0
        while overlap and back - 1 > first and repeated < overlap:
            back -= 1
            repeated += spans[back][1] - spans[back][0]
        carried = spans[after - 1][1] - spans[back][0] if back < after else 0
        first = back
    return chunks


CHUNKS = types.ArrayType(types.StructType([*SPANS.elementType.fields, types.StructField("carried", types.IntegerType()), types.StructField("complete", types.BooleanType())]))


def chunker(cap: int = 6_000, overlap: int = 500):
    @F.pandas_udf(CHUNKS)
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [f.name for f in CHUNKS.elementType.fields]
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(names, c)) for c in pack_chunks(sentence_spans(t), cap, overlap)] if t else [])

    return chunks
