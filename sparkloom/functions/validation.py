"""Checks of what an item displays, as expressions: broken texts, assertions, quantities, pointers, acronyms, options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.display import names_a_referent, requires_context, unresolved_acronyms
from sparkloom.functions.text import normalize

# Patterns, words, units and bounds of the checks.
MALFORMED = r"[\r\n]|[^\S\r\n]{3,}"
QUOTATION = "[\"“]([^\"“”]{2,})[\"”]"
MOST_QUOTED_WORDS = 8
NEGATION = r"\b(?:not|no|never|without|except|unless|neither|nor)\b"
CONNECTIVE = r"\b(?:or|either|and|but|although|though|while|whereas|if)\b"
RANGE = r"(?i)[0-9]\s*(?:to|through|–|—|-)\s*[-+]?[0-9]"
RELATIVE_PERIOD = (
    r"(?i)\b(?:the\s+)?(?:past|last|previous|recent)\s+(?:[0-9]+\s+|few\s+|several\s+|couple\s+of\s+)?(?:year|decade|century|month|day|week)s?\b"
    r"|\bin\s+recent\s+(?:year|decade)s\b|\bat\s+(?:this|the\s+present)\s+time\b|\b(?:until|up\s+to)\s+(?:the\s+)?present\b|\brecently\b"
)
SOURCE_LOCATOR = (
    r"(?i)\bdoi\b|\baccording to (?:(?:the|this|a) )?(?:study|paper|article|publication)\b|\b(?:study|paper|article|publication) (?:titled|entitled)\b"
    r"|\b(?:reported )?table(?:\s+(?:on\s+page\s+)?[0-9]+|\s+row\b)|\bfig(?:ure)?\.?\s*[0-9]+\b"
    r"|\b(?:the|that|this)\s+(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|final|left|right|top|bottom|[0-9]+(?:st|nd|rd|th))\s+(?:column|row|panel|subplot|entry)s?\b"
    r"|\bthe\s+(?:above|following)\s+(?:table|figure|panel|column|row)s?\b"
)
BRACKET_CITATION = r"\[\s*[0-9]+(?:\s*[;,–-]\s*[0-9]+)*\s*\]"
LOCATOR_WORD = r"(?i:\b(?:fig(?:ure|s)?|tab(?:le|s)?|eq(?:uation|s)?|suppl(?:ementary|ement)?|sect(?:ion)?|panel|appendix)\b\.?\s*(?:S?[0-9]|[IVX]+\b))"
AUTHOR_YEAR = r"(?:e\.g\.,?\s*)?[A-Z]\p{L}+(?:\s+(?:et\s+al\.?|and\s+[A-Z]\p{L}+|&\s+[A-Z]\p{L}+))?,?\s*[0-9]{4}[a-z]?"
RESIDUAL_LOCATOR = r"(?i)\b(?:fig(?:ure|s)?|tab(?:le|s)?|eq(?:uation|s)?|suppl(?:ementary|ement)?|sect(?:ion)?|panel|appendix)\s*\.?\s*(?:[0-9]|[IVX]+\b|S[0-9])"
#: Stems of finite verbs; each may end as given after it.
FINITE_VERBS = (
    "is are was were has have had do does did can could will would show(?:s|ed|n)? report(?:s|ed)? increas(?:e|es|ed) decreas(?:e|es|ed) declin(?:e|es|ed) rang(?:e|es|ed) occur(?:s|red)?"
    " reach(?:es|ed)? exceed(?:s|ed)? averag(?:e|es|ed) remain(?:s|ed)? var(?:y|ies|ied) contribut(?:e|es|ed) represent(?:s|ed)? indicat(?:e|es|ed) found observed measured estimated"
    " account(?:s|ed)? correlat(?:e|es|ed) differ(?:s|ed)? took take(?:s|n)? collect(?:s|ed)? sampl(?:e|es|ed) conduct(?:s|ed)? perform(?:s|ed)? carr(?:y|ies|ied) locat(?:e|es|ed)"
    " situat(?:e|es|ed) us(?:e|es|ed) deploy(?:s|ed)? obtain(?:s|ed)? record(?:s|ed)? analys(?:e|es|ed) analyz(?:e|es|ed) includ(?:e|es|ed) consist(?:s|ed)? cover(?:s|ed)? span(?:s|ned)?"
    " last(?:s|ed)? began begin(?:s)? start(?:s|ed)? end(?:s|ed)? ran run(?:s)? isolat(?:e|es|ed) deriv(?:e|es|ed) defin(?:e|es|ed) denot(?:e|es|ed) refer(?:s|red)? mean(?:s|t)? stand(?:s)?"
    " compris(?:e|es|ed) lie(?:s)? lay extend(?:s|ed)? belong(?:s|ed)? occupi(?:es|ed) receiv(?:e|es|ed) appl(?:y|ies|ied) select(?:s|ed)? describ(?:e|es|ed) operat(?:e|es|ed) driv(?:e|es|en)"
    " drove install(?:s|ed)? mount(?:s|ed)? equip(?:s|ped)? fitted held hold(?:s)? flew fl(?:y|ies) made make(?:s)? gave give(?:s)? placed kept keep(?:s)? stood grew grow(?:s)? form(?:s|ed)?"
    " sail(?:s|ed)? visit(?:s|ed)? travel(?:s|led|ed)? arriv(?:e|es|ed) left leave(?:s)? return(?:s|ed)? follow(?:s|ed)? continu(?:e|es|ed) complet(?:e|es|ed) determin(?:e|es|ed)"
    " calculat(?:e|es|ed) comput(?:e|es|ed) identif(?:y|ies|ied) characteri[sz](?:e|es|ed) process(?:es|ed)? stor(?:e|es|ed) prepar(?:e|es|ed) treat(?:s|ed)? expos(?:e|es|ed) incubat(?:e|es|ed)"
    " cultur(?:e|es|ed) grown sequenc(?:e|es|ed) extract(?:s|ed)? filter(?:s|ed)? weigh(?:s|ed)? count(?:s|ed)? provid(?:e|es|ed) suppl(?:y|ies|ied) yield(?:s|ed)? produc(?:e|es|ed)"
).split()
FACTORS = {("m", "cm"): "100", ("cm", "m"): "0.01", ("km", "m"): "1000", ("m", "km"): "0.001", ("kg", "g"): "1000", ("g", "kg"): "0.001"}
KELVIN = "273.15"
INTEGER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()

EXACT = "decimal(38,12)"


def malformed(text: Column) -> Column:
    """A line break, a gutter of blanks, or a quotation of more than eight words. False for null and empty texts."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTATION), 1)
    long = F.exists(quoted, lambda q: F.size(F.regexp_extract_all(q, F.lit(r"(\S+)"), 1)) > MOST_QUOTED_WORDS)
    return F.coalesce(text.rlike(MALFORMED) | long, F.lit(False))


def ascii_bounds(pattern: str) -> str:
    """A pattern whose words end at all but ASCII letters, digits and _, as SQL engines take it; in Java's \\b the letters
    and their marks depend on the version."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def assertion_issue(text: Column, ascii_only: bool = False) -> Column:
    """What is wrong with a displayed assertion: negated or compound; null if nothing. ascii_only: letters and white space
    are those of ASCII, so that a word ends before an accented letter."""
    if ascii_only:  # a dotted capital I has no mark of its own in lower case there
        flat = F.trim(F.regexp_replace(F.lower(F.translate(text, "\u0130", "i")), r"[\t\n\f\r ]+", " "))
        negation, connective = ascii_bounds(NEGATION), ascii_bounds(CONNECTIVE)
    else:
        flat, negation, connective = normalize(text), NEGATION, CONNECTIVE
    compound = text.contains(";") | flat.rlike(connective) | flat.contains("followed by")
    return F.when(flat.rlike(negation), "displayed_assertion_negated").when(compound, "displayed_assertion_compound")


def context_reason(displayed: Column, context: Column) -> Column:
    """The first failure of a displayed text and its context; null if none. A text that points at something of its study
    needs a context, which names it and leaves no acronym open."""
    both = F.concat_ws("\n", displayed, context)
    needs = F.coalesce(requires_context(displayed), F.lit(False))
    unnamed = (F.size(unresolved_acronyms(both)) > 0) | ~names_a_referent(context)
    return (
        F.when(malformed(displayed) | malformed(context), "benchmark_text_malformed")
        .when(both.rlike(SOURCE_LOCATOR), "source_dependent_locator")
        .when(both.rlike(RELATIVE_PERIOD), "publication_relative_period")
        .when(needs & (F.coalesce(F.trim(context), F.lit("")) == ""), "question_context_missing")
        .when(needs & unnamed, "question_context_referent_unresolved")
    )


def converted(value: Column, source: Column, target: Column) -> Column:
    """A decimal in another unit; null where the units aren't known to each other, or for what is no number or too
    long a one."""
    a, b = F.lower(source), F.lower(target)
    out = F.when(a == b, value.try_cast(EXACT))
    for (x, y), factor in FACTORS.items():
        out = out.when((a == x) & (b == y), F.try_multiply(value.try_cast("decimal(24,9)"), F.lit(factor).cast("decimal(10,3)")).try_cast(EXACT))
    celsius = lambda u: u.isin("c", "°c")
    kelvin = F.lit(KELVIN).cast("decimal(5,2)")
    exact = value.try_cast("decimal(30,12)")
    return out.when(celsius(a) & (b == "k"), F.try_add(exact, kelvin).try_cast(EXACT)).when((a == "k") & celsius(b), F.try_subtract(exact, kelvin).try_cast(EXACT))


def numeric_equal(left: Column, left_unit: Column, tolerance: Column, right: Column, right_unit: Column) -> Column:
    """Whether two quantities agree within the tolerance of the left; false where they can't be compared."""
    apart = F.abs(F.try_subtract(left.try_cast(EXACT), converted(right, right_unit, left_unit)))
    return F.coalesce(apart <= tolerance.try_cast(EXACT), F.lit(False))


def displayed_quantities(text: Column, unit: Column) -> Column:
    """Numbers, and whole numbers in words, that the text gives with the unit."""
    quoted = F.regexp_replace(F.regexp_replace(F.trim(unit), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    ends = F.concat(F.lit(r"\s*(?i:"), quoted, F.lit(r")(?!\w)"))
    digits = F.regexp_extract_all(text, F.concat(F.lit(r"(?<![\w.])([-+]?[0-9]+(?:\.[0-9]+)?)(?![0-9.])"), ends), 1)
    words = F.regexp_extract_all(normalize(text), F.concat(F.lit(r"(?<!\S)(" + "|".join(INTEGER_WORDS) + r")(?!\S)"), ends), 1)
    value = F.create_map(*[F.lit(x) for i, w in enumerate(INTEGER_WORDS) for x in (w, str(i))])
    return F.concat(F.transform(digits, lambda x: x.cast(EXACT)), F.transform(words, lambda w: value[w].cast(EXACT)))


def numeric_display_issue(text: Column, value: Column, unit: Column) -> Column:
    """Whether a number kept of an option isn't the one quantity that it displays; null if it is."""
    plain = F.translate(text, "−–—", "---")
    number = F.translate(value, "−–—", "---").try_cast(EXACT)
    shown = displayed_quantities(plain, unit)
    return (
        F.when(number.isNull() | unit.isNull(), "numeric_metadata_not_scalar")
        .when(plain.contains(";") | plain.rlike(RANGE) | (F.size(shown) != 1), "numeric_display_ambiguous")
        .when(F.get(shown, F.lit(0)) != number, "numeric_metadata_display_mismatch")
    )


def option_key(text: Column, members: Column, ordering: Column) -> Column:
    """Options of equal keys are one option: the normal form of the text or, of a closed set, its members."""
    own = F.when(ordering == "ordered", members).otherwise(F.array_sort(members))
    return F.when(members.isNull(), F.array(F.lit("text"), normalize(text))).otherwise(F.concat(F.array(F.lit("closed_set"), ordering), own))


def redact_locators(text: Column) -> Column:
    """Citations and pointers to figures, tables or authors go; the sentence stays."""
    t = F.regexp_replace(text, BRACKET_CITATION, "")
    pointer = rf"\((?=[^()]{{0,200}}\))(?=[^()]*?(?:{LOCATOR_WORD}|{AUTHOR_YEAR}))[^()]*\)"
    t = F.regexp_replace(F.regexp_replace(t, pointer, ""), r"\(\s*\)|\[\s*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+([,.;:)])", "$1"), r"[ \t]{2,}", " "))


def context_display(text: Column, finite_verb: str = rf"(?i)\b(?:{'|'.join(FINITE_VERBS)})\b") -> Column:
    """What is shown of a span of context: redacted, a complete sentence, without a pointer left; else null."""
    shown = redact_locators(text)
    whole = (F.length(shown) >= 16) & shown.rlike(r"[.!?][\"'”’)\]]*\s*$") & shown.rlike(finite_verb)
    return F.when(~text.rlike(r"[ \t]{8,}") & ~shown.rlike(RESIDUAL_LOCATOR) & whole, shown)
