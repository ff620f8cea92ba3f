"""Enumerations as sets: members of a displayed list, whether a source states a whole set, options of one set; units and
quantities in a normal form. Expressions; null texts and values give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize, once

# What leads a list, parts it, stands before a member, and says that a list is whole or is not.
LEAD = r"\b(?:including|included|such as|namely|comprising|consisting of|consists of|composed of|i\.?e\.?)\b\s*"
NO_LIST = r";|\b(?:or|either|but|although|though|while|whereas|if)\b"
PART = r"\s*,\s*|\s+and\s+|\s+followed\s+by\s+|\s+then\s+|\s*>\s*"
RANK = r"^(?:the\s+)?(?:phylum|phyla|class|order|family|genus|species|division|clade|group)\s+(?=\S)"
WHOLE = r"\b(?:consists? of|comprises?|complete set)\b"
NOT_WHOLE = r"\b(?:examples?|including|included|such as|among)\b"
COUNTED = r"i\.?e\.?|namely|following"
CARDINALS = "two three four five six seven eight nine ten".split()
# Spellings of units, and words for bounds.
UNITS = {
    "%": ["percent", "percentage"],
    "m": ["meter", "meters", "metre", "metres"],
    "km": ["kilometer", "kilometers", "kilometre", "kilometres"],
    "cm": ["centimeter", "centimeters", "centimetre", "centimetres"],
    "mm": ["millimeter", "millimeters", "millimetre", "millimetres"],
    "°c": ["deg c", "degc", "degrees c", "degrees celsius"],
    "h": ["hr", "hrs", "hour", "hours"],
    "year": ["yr", "yrs", "years"],
    "day": ["d", "days"],
}
NUMERIC_WORDS = [
    (r"\b(?:per\s*cent|percentage)\b", "%"),
    *[(rf"\b(?:{'|'.join(spellings)})\b", unit) for unit, spellings in UNITS.items() if unit != "%"],
    (r"\b(?:approximately|approx(?:\.|imately)?|about)\b", "approx"),
    (r"\b(?:above|greater than|more than)\s*", "> "),
    (r"\b(?:below|less than|fewer than)\s*", "< "),
    ("≥", ">="),
    ("≤", "<="),
    (r"(?<=[0-9])\s*[-–]\s*(?=[0-9])", " to "),
    (r"\s*%\s*", "%"),
    (r"(?U)[^\w%°.+<>=\-]+", " "),
]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ .]+|[ .]+$", "")


def bare_member(text: Column) -> Column:
    return stripped(F.regexp_replace(text, RANK, ""))


def members(text: Column, typed: Column | None = None) -> Column:
    """The members of an enumeration, of typed values where an option has them; null if it is none: fewer than two
    members, an empty one, or a choice or clause among them."""
    plain = once(stripped(normalize(text)), lambda t: stripped(F.regexp_replace(t, r"(?sU)^.*?" + LEAD, "")))
    parts = once(plain, lambda t: F.when(~t.rlike("(?U)" + NO_LIST), F.transform(F.split(F.regexp_replace(t, r",\s+and\s+", ", "), PART, -1), lambda p: bare_member(stripped(p)))))
    own = once(parts, _if_list)
    if typed is None:
        return own
    given = F.transform(typed, lambda v: bare_member(stripped(normalize(v))))
    return F.when(F.size(typed) > 0, once(given, _if_list)).otherwise(own)


def _if_list(parts: Column) -> Column:
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: F.coalesce(p != "", F.lit(False))), parts)


GENUS, SHORT_GENUS = r"^([a-z][a-z-]+)\s+([a-z][a-z-]+)$", r"^([a-z])\.\s*([a-z][a-z-]+)$"


def member_keys(values: Column) -> Column:
    """Values with the genus of a binomial cut short written out; null if two genera begin with its letter."""
    genera = F.array_distinct(F.transform(F.filter(values, lambda v: v.rlike(GENUS)), lambda v: F.regexp_extract(v, GENUS, 1)))

    def keys(known: Column) -> Column:
        initials = F.transform(known, lambda g: F.substring(g, 1, 1))

        def key(v: Column) -> Column:
            at = F.array_position(initials, F.regexp_extract(v, SHORT_GENUS, 1)).cast("int")
            return F.when(v.rlike(SHORT_GENUS) & (at > 0), F.concat_ws(" ", F.get(known, at - 1), F.regexp_extract(v, SHORT_GENUS, 2))).otherwise(v)

        return F.when(F.size(F.array_distinct(initials)) == F.size(known), F.transform(values, key))

    return once(genera, keys)


def states_whole_set(source: Column, values: Column) -> Column:
    """Whether a clause of the source holds all values and says that they are all: by a verb, or by their number."""
    text, own = normalize(source), F.transform(values, normalize)

    def judged(t: Column, v: Column) -> Column:
        at = F.transform(v, lambda x: F.instr(t, x))
        first = F.array_min(at)
        last = F.array_max(F.zip_with(at, v, lambda a, x: a + F.length(x)))
        before = F.regexp_replace(F.substring(t, F.lit(1), first - 1), r"(?s)^.*;", "")
        clause = F.concat(before, F.substring(t, first, last - first), F.regexp_extract(F.substring(t, last, F.length(t)), "^[^;]*", 0))
        n = F.size(v)
        word = F.get(F.array(*[F.lit(w) for w in CARDINALS]), n - 2)
        count = F.concat(F.lit(r"\b(?:exactly\s+)?(?:"), n.cast("string"), F.coalesce(F.concat(F.lit("|"), word), F.lit("")), F.lit(r")\b"))
        counted = F.regexp(clause, F.concat(F.lit(r"\bexactly\s+(?:"), n.cast("string"), F.coalesce(F.concat(F.lit("|"), word), F.lit("")), F.lit(r")\b"))) | F.regexp(clause, F.concat(count, F.lit(rf".*(?:{COUNTED})\b")))
        # a clause may end within the values
        inside = F.forall(v, lambda x: F.contains(clause, x))
        return (first > 0) & inside & (clause.rlike("(?U)" + WHOLE) | (~clause.rlike("(?U)" + NOT_WHOLE) & counted))

    return F.coalesce(once(text, lambda t: once(own, lambda v: judged(t, v))), F.lit(False))


def contract(answer: Column, evidence: Column, rule: Column, option: Column, option_rule: Column) -> Column:
    """(answer_keys, option_keys, ordering) of an answer and an option that are sets of the same number of members; null
    where they are not. rule: kind, source_values, member_type, ordering; option_rule: kind, candidate_value,
    candidate_values, member_type, ordering. The option counts as displayed: typed values can't stand for other ones."""
    kind = (rule["kind"] == "closed_set") & (option_rule["kind"] == "closed_set")
    member_type, ordering = F.coalesce(rule["member_type"], F.lit("categorical_entity")), F.coalesce(rule["ordering"], F.lit("unordered"))
    same_rules = (member_type != "quantity") & ordering.isin("ordered", "unordered") & (F.coalesce(option_rule["ordering"], ordering) == ordering) & (F.coalesce(option_rule["member_type"], member_type) == member_type)
    plain = lambda values: F.transform(values, lambda v: stripped(normalize(v)))
    source, shown, displayed = plain(rule["source_values"]), members(answer), members(option)
    typed = F.coalesce(plain(option_rule["candidate_values"]), displayed)
    sets = F.array(source, shown, typed, displayed)

    def judged(s: Column) -> Column:
        n = F.size(F.get(s, F.lit(0)))
        sized = F.forall(s, lambda x: F.coalesce((F.size(x) == n) & F.forall(x, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(False)))

        def matched(keys: Column) -> Column:
            source_, shown_, typed_, displayed_ = (F.slice(keys, n * k + 1, n) for k in range(4))
            equal = lambda a, b: F.when(ordering == "ordered", a == b).otherwise(F.array_sort(a) == F.array_sort(b))
            distinct = F.lit(True)
            for x in (source_, shown_, typed_):
                distinct = distinct & (F.size(F.array_distinct(x)) == n)
            return F.when(distinct & equal(source_, shown_) & equal(typed_, F.array_distinct(displayed_)), F.struct(shown_.alias("answer_keys"), typed_.alias("option_keys"), ordering.alias("ordering")))

        return F.when((n >= 2) & sized, once(member_keys(F.flatten(s)), matched))

    named = normalize(option_rule["candidate_value"]) == normalize(option)
    return F.when(F.coalesce(kind & same_rules & named & states_whole_set(evidence, rule["source_values"]), F.lit(False)), once(sets, judged))


def units_equal(left: Column, right: Column) -> Column:
    """Whether two units are one, by their spellings; false for empty ones."""
    spelled = F.create_map(*[F.lit(x) for unit, names in UNITS.items() for name in names for x in (name, unit)])
    unit = lambda c: once(normalize(c), lambda u: F.coalesce(spelled[u], u))
    return F.coalesce((normalize(left) != "") & (unit(left) == unit(right)), F.lit(False))


def numeric_text(text: Column) -> Column:
    """A text with quantities in a normal form: one spelling of each unit and bound, ranges with "to"."""
    t = normalize(text)
    for pattern, by in NUMERIC_WORDS:
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^\.+|\.+$", "")
