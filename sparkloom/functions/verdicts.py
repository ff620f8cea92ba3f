"""Decisions on candidates as expressions: answers given away, scopes that contradict, claims, verdicts on options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize

# Patterns, words and reasons of the decisions.
NUMBER = r"(?<![\w.])([+\-−]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:[eE][+\-−]?[0-9]+)?)(?![0-9.,])"
YEAR = r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])"
YEAR_RANGE = r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})\s*(?:-|to|and|through|until)\s*(1[89][0-9]{2}|20[0-9]{2})(?![0-9])"
PLUS_MINUS = r"\s*(?:±|\+\s*/?\s*-)\s*"
STATISTIC = r"\s*\(\s*(?:sd|se|sem|s\.d\.|s\.e\.|σ)\s*=\s*"
MOST_YEARS = 150
SHORTEST_IN_CONTEXT = 4
NOT_CAUSAL = ("observation", "association", "definition")
META_OPTIONS = ("all of the above", "none of the above")


def match_text(text: Column) -> Column:
    """Words, numbers and their signs only, without an opening yes or no; what answers are compared by."""
    t = F.regexp_replace(normalize(text), r"^(?:yes|no)\s*[,;:]?\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w%°.+\-−]+", " "), r"\. ", " ")
    return normalize(F.regexp_replace(t, r"^\.+|\.+$", ""))


def holds(text: Column, phrase: Column) -> Column:
    """Whether a match text holds another, not within a word."""
    return F.regexp(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)")))


def _given_away(text: Column, answers: Column, shortest: int) -> Column:
    worth = F.filter(F.transform(answers, match_text), lambda a: ~a.isin("", "yes", "no") & (F.length(a) >= shortest))
    # an array of one text, so that its form is computed once and not for each answer
    found = F.exists(F.array(match_text(text)), lambda shown: (shown != "") & F.exists(worth, lambda a: holds(shown, a)))
    return F.coalesce(found, F.lit(False))


def question_leak(question: Column, answers: Column) -> Column:
    """Whether a question, or a phrase that it must hold, gives an answer or a variant away. False for nulls."""
    return _given_away(question, answers, 1)


def context_leak(context: Column, answers: Column) -> Column:
    """Whether a context holds an answer of four characters or more, or a number of the first. False for nulls."""
    number = lambda c: F.regexp_extract_all(c, F.lit(f"(?U){NUMBER}"), 1)
    shared = F.coalesce(F.arrays_overlap(number(F.get(answers, F.lit(0))), number(context)), F.lit(False))
    return F.coalesce(match_text(context) != "", F.lit(False)) & (_given_away(context, answers, SHORTEST_IN_CONTEXT) | shared)


def calendar_years(text: Column) -> Column:
    """Every year that a scope names, ranges of at most 150 years filled in."""
    flat = normalize(F.translate(text, "‐‑‒–—−", "------"))
    first, last = (F.transform(F.regexp_extract_all(flat, F.lit(YEAR_RANGE), g), lambda y: y.cast("int")) for g in (1, 2))
    spans = F.zip_with(first, last, lambda a, b: F.when(a.between(b - MOST_YEARS, b), F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    named = F.transform(F.regexp_extract_all(flat, F.lit(YEAR), 1), lambda y: y.cast("int"))
    return F.array_distinct(F.concat(F.flatten(spans), named))


def scopes_contradict(left: Column, right: Column) -> Column:
    """Both name years and share none. False for nulls."""
    a, b = calendar_years(left), calendar_years(right)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def claim_types_agree(first: Column, second: Column) -> Column:
    """Two judges' labels of a question; causal agrees with no other known label, the others do with each other."""
    one = lambda a, b: F.coalesce((a == "causal") & b.isin(*NOT_CAUSAL), F.lit(False))
    return ~(one(first, second) | one(second, first))


def claim_type_reasons(answer: Column, first: Column, second: Column) -> Column:
    """Why the labels of a claim reject it: the judges disagree, or read a cause in what was only seen together."""
    causal = F.coalesce(first == "causal", F.lit(False)) | F.coalesce(second == "causal", F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~claim_types_agree(first, second), "question_claim_type_disagreement"),
            F.when(answer.isin("observation", "association") & causal, "causal_overclaim"),
        )
    )


def option_verdict_reason(contradicted: Column, has_reading: Column, standalone: Column, searched: Column, admitted: Column, reading: Column) -> Column:
    """Why a verdict rejects its option; null if it doesn't. has_reading: the record tells how an option could be right
    (else it is of the older form, which tells whether other answers were searched). A null flag is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = F.coalesce(F.trim(reading) != "", F.lit(False))
    right = "option_correct_under_question_interpretation"
    newer = F.when(~yes(standalone), "option_standalone_uninterpretable").when(yes(admitted), F.when(told, right).otherwise("option_admission_unexplained"))
    older = F.when(~yes(searched), "distractor_alternative_answer_possible").when(yes(admitted), right)
    return F.when(~yes(contradicted), "option_contradiction_unresolved").when(yes(has_reading), newer).otherwise(older)


def option_reason(text: Column, answers: Column, repeated: Column, same_set: Column, context: Column, display: Column, number: Column, same_number: Column) -> Column:
    """Why an option goes before any model looks at it; null if it stays.

    repeated, same_set and same_number: it equals an earlier option, the answer's members, the answer's number; context,
    display and number: the reasons found by those checks, null if none."""
    flat = normalize(text)
    return F.coalesce(
        F.when(repeated, "duplicate_or_equivalent_distractor"),
        F.when(F.exists(answers, lambda a: normalize(a) == flat) | same_set, "distractor_matches_answer"),
        F.when(flat.isin(*META_OPTIONS), "forbidden_meta_option"),
        context,
        display,
        number,
        F.when(same_number, "distractor_is_equivalent_numeric_answer"),
    )


def unevidenced(passed: Column, reasons: Column, phrases: Column, readings: Column) -> Column:
    """Whether a failing verdict shows nothing of what it found: no phrase that is undefined, no two readings."""
    written = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    undefined = F.exists(reasons, lambda r: r.startswith("undefined_")) & (written(phrases) == 0)
    ambiguous = F.array_contains(reasons, "multiple_interpretations") & (written(readings) < 2)
    return F.coalesce(~passed, F.lit(False)) & (F.coalesce(undefined, F.lit(False)) | F.coalesce(ambiguous, F.lit(False)))


def gate_reasons(in_question: Column, in_context: Column, rule: Column, leak_absent: Column, judged: Column) -> Column:
    """All reasons against a displayed task, each once: leaks, the first broken rule, then the judge's codes."""
    own = F.array(
        F.when(in_question, "question_answer_leakage"),
        F.when(in_context, "question_context_answer_leakage"),
        rule,
        F.when(~leak_absent, "standalone_answer_leakage"),
    )
    codes = F.transform(F.coalesce(judged, F.array().cast("array<string>")), lambda r: F.concat(F.lit("standalone_"), r))
    return F.array_distinct(F.array_compact(F.concat(own, codes)))


def uncertain_quantities(text: Column, unit: Column) -> Column:
    """Values and their uncertainties that share one unit: a plus-minus clause before it, or a statistic in brackets
    after it. Null for a null text or unit."""
    named = F.concat(F.lit(r"\s*\Q"), F.trim(unit), F.lit(r"\E(?!\w)"))
    spread = F.concat(F.lit(f"(?iU){NUMBER}{PLUS_MINUS}{NUMBER}"), named)
    bracket = F.concat(F.lit(f"(?iU){NUMBER}"), named, F.lit(rf"[^()0-9]{{0,39}}?{STATISTIC}{NUMBER}\s*\)"))
    found = [F.regexp_extract_all(text, pattern, F.lit(g)) for pattern in (spread, bracket) for g in (1, 2)]
    return F.array_distinct(F.transform(F.concat(*found), lambda n: F.translate(n, "−,", "-").try_cast("decimal(38,12)")))
