"""What a reader sees of a phrase or an acronym: windows of tokens, initials aligned with words, as expressions.

Rows are taken one by one and nothing is exploded, so repeated rows are judged alike. Null phrases and texts show
nothing; a phrase of function words alone shows nothing, nor does one that a boundary cuts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize, once

# Dashes taken as one, what may be joined, what separates noun phrases, and words without content.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
SOFT_HYPHEN = "­"
LINE_HYPHEN = r"(?<=\p{L})-[^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*(?=\p{L})"
SPLIT_TOKEN = r"(?<=\b[A-Z])\s+(?=[0-9])|(?<=\b[A-Z][A-Za-z])\s+(?=[0-9])|(?<=\b[A-Z][A-Za-z]{2})\s+(?=[0-9])|(?<=\b[A-Za-z])\s+(?=-?[0-9])|(?<=[A-Za-z])\s+(?=-[0-9])"
GLOSS = r"\(\s*([A-Z][A-Za-z0-9]*(?:[\s-]+[A-Z][A-Za-z0-9]*)*)\s*\)"
FUNCTION_WORDS = (
    "a an the of in on at to from for by with within across during between over under into near along per through among since until all both each this that these"
    " those its their s"
).split()
COORDINATORS = "and or nor but versus vs than".split()
BREAKS = ",;:()[]?!/"
GLUE_WORDS = "of the and for in on at a an to".split()
VERSION = r"(?i)\s*(?:version|ver\.?|v\.?)\s*[0-9]+(?:\.[0-9]+)*[A-Za-z]?\s*$"
GLOSS_WORD = r"([A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z][A-Za-z0-9]*)*)"
GENE_PREFIX = r"\b(?:bla|mec|van)\s?"
ACRONYM = r"\b[A-Z][A-Z0-9]{1,7}\b"
KNOWN_TOKENS = (
    "CH4 CO2 DNA N2O O2 RNA II III IV VI UTC GMT AD BC CE BCE GPS PCR UV SI RMSE SD NAO ENSO CFU RMS RMSD SE SEM CMIP5 CMIP6 PM10 NH4 SO42"
    " NE NW SW NNE ENE ESE SSE SSW WSW WNW NNW"
).split()
GLOSS_VERBS = "means|denotes|is short for|stands for|refers to|identifies|is defined as|is the|are the|is an?|are|was the|were the|represents|designates|corresponds to"
NAMED_AS = r"\b(?:abbreviated|denoted|designated|referred to|termed|known|labelled|labeled|hereafter)\s+(?:as\s+)?(?:the\s+)?|\b(?:abbreviation|acronym)\s+"
BINOMIAL = r"\b[A-Z]\.\s*[a-z][a-z-]+\b"
REFERENT_NOUNS = (
    "station|site|group|sample(?:s)?|experiment|dataset|sampling|otu(?:s)?|expedition(?:s)?|cruise(?:s)?|campaign(?:s)?|transect(?:s)?|enclosure(?:s)?|archipelago|lake|wetland|fjord|pond(?:s)?"
    "|core(?:s)?|run(?:s)?"
)
REFERENT = (
    r"(?i)\b(?:this|that|these|those)\s+(?:study|experiment|sampling|dataset|station|site|group|sample(?:s)?|otu(?:s)?|archipelago)\b"
    r"|\b(?:the|this|these|those)\s+(?:(?:southern|northern|eastern|western|central|upper|lower|identified|sampled|selected|combined|pooled|deep|shallow)\s+)?"
    rf"(?:{REFERENT_NOUNS})\b"
    r"|\b(?:identified|sampled|selected)\s+(?:otu(?:s)?|groups?|samples?)\b|\bsampled\s+group\b"
)
CONTEXT_FILLER = (
    "a an and at central degree degrees during e east eastern experiment from group identified in latitude lower n north northern of on or s sample sampled samples sampling selected site south"
    " southern station study the this those to upper was were west western"
).split()

#: Stands for the end of a noun phrase among tokens.
BOUNDARY = "|"
TOKEN = r"([\p{L}\p{N}]+|\|)"
SENTENCE_END = r"\.(?=\s+[A-ZЀ-Я]|\s*$)"


def among(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def folded(text: Column) -> Column:
    return F.replace(normalize(text), F.lit("ß"), F.lit("ss"))


def joined(text: Column, units: bool = True) -> Column:
    """The text with one kind of dash, without soft hyphens, with words and (if asked) units whole that a line or a blank
    cuts."""
    plain = F.replace(F.translate(text, DASHES, "-" * len(DASHES)), F.lit(SOFT_HYPHEN), F.lit(""))
    lines = once(plain, lambda t: F.when(t.rlike(r"-[^\S\r\n]*[\r\n]"), F.regexp_replace(t, LINE_HYPHEN, "")).otherwise(t))
    if not units:
        return lines
    # few texts have a number after a blank, and looking behind each blank is slow
    return once(lines, lambda t: F.when(t.rlike(r"\s-?[0-9]"), F.regexp_replace(t, SPLIT_TOKEN, "")).otherwise(t))


def tokens(text: Column, units: bool = True) -> Column:
    """Lower-case tokens, BOUNDARY where a noun phrase ends: at coordinators, clause marks and ends of sentences. The
    brackets around an acronym are no boundary. units: as in joined."""
    bare = once(joined(text, units), lambda t: F.when(t.contains("("), F.regexp_replace(t, GLOSS, " $1 ")).otherwise(t))
    marked = F.regexp_replace(F.translate(bare, BOUNDARY + BREAKS, "~" + BOUNDARY * len(BREAKS)), SENTENCE_END, BOUNDARY)
    found = F.regexp_extract_all(F.replace(F.lower(marked), F.lit("ß"), F.lit("ss")), F.lit(TOKEN), 1)
    return F.transform(found, lambda t: F.when(among(t, COORDINATORS), BOUNDARY).otherwise(t))


def content(phrase: Column, units: bool = True) -> Column:
    """The tokens of a phrase that have to be shown; null if it is not one phrase, or has none."""
    bare = F.regexp_replace(F.array_join(tokens(phrase, units), " "), r"^(?:\| ?)+|(?: ?\|)+$", "")
    kept = F.filter(F.split(bare, " "), lambda t: ~among(t, FUNCTION_WORDS) & (t != ""))
    return F.when(~bare.contains(BOUNDARY) & (F.size(kept) > 0), kept)


def in_window(needed: Column, shown: Column) -> Column:
    """Whether the needed tokens stand in order in a window of 2 n + 2 shown ones without a boundary between them."""
    return F.coalesce(once(needed, lambda n: once(shown, lambda s: _in_window(n, s))), F.lit(False))


def _in_window(needed: Column, shown: Column) -> Column:
    first, bound = F.get(needed, F.lit(0)), 2 * F.size(needed) + 2
    more = F.slice(needed, F.lit(2), F.greatest(F.size(needed) - 1, F.lit(0)))

    def follows(window: Column) -> Column:
        """A walk over the window: the place of the last token found, 0 once one is missing."""
        end = once(F.array_position(window, F.lit(BOUNDARY)), lambda b: F.when(b > 0, b - 1).otherwise(F.size(window)))

        def step(place: Column, token: Column) -> Column:
            rest = F.slice(window, place + 1, F.greatest(F.size(window) - place, F.lit(0)))
            found = once(F.array_position(rest, token).cast("int"), lambda k: F.when(k > 0, place + k).otherwise(F.lit(0)))
            return F.when(place > 0, found).otherwise(F.lit(0))

        return once(F.aggregate(more, F.lit(1), step), lambda last: (last > 0) & (last <= end))

    starts = F.filter(F.transform(shown, lambda t, i: F.when(t == first, i)), lambda i: i.isNotNull())
    windows = F.exists(starts, lambda i: once(F.slice(shown, i + 1, bound), follows))
    return F.array_contains(shown, first) & windows


def contained(phrase: Column, text: Column) -> Column:
    """Whether the text holds the phrase as it stands, but for white space, dashes and cut words."""
    has = lambda projection: once(projection(phrase), lambda p: (p != "") & F.contains(projection(text), p))
    repaired = lambda c: folded(F.regexp_replace(c, LINE_HYPHEN, ""))
    return F.coalesce(has(lambda c: folded(joined(c))) | has(repaired), F.lit(False))


def is_displayed(phrase: Column, *texts: Column) -> Column:
    """Whether one of the texts shows the phrase: as it stands, or its content in one noun phrase."""
    shown = F.lit(False)
    needed = content(phrase)
    for text in texts:
        shown = shown | contained(phrase, text) | once(needed, lambda n: in_window(n, tokens(text)))
    return shown


def gloss_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GLOSS_WORD), 1)


def initials_match(words: Column, letters: Column) -> Column:
    """Whether the last words spell the letters: a word gives its first letter, a compound one letter or one for each
    part, a glue word one or none. Aligned from the right by the set of letters that can still be open."""
    return once(letters, lambda c: _initials_match(words, c))


def _initials_match(words: Column, letters: Column) -> Column:
    last = F.transform(F.reverse(words), F.lower)
    near = F.slice(last, F.lit(1), 2 * F.length(letters) + 4)

    def step(open_: Column, word: Column) -> Column:
        parts = F.filter(F.split(word, "[-/]"), lambda p: p != "")
        firsts = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")

        def after(k: Column) -> Column:
            n = F.size(parts)
            whole = F.when((k > 0) & (F.substring(letters, k, F.lit(1)) == F.substring(word, 1, 1)), k - 1)
            each = F.when((n > 1) & (k >= n) & (F.substring(letters, k - n + 1, n) == firsts), k - n)
            return F.array(F.when(among(word, GLUE_WORDS) | (k == 0), k), whole, each)  # none open: done, whatever comes before

        return F.array_distinct(F.filter(F.flatten(F.transform(open_, after)), lambda k: k.isNotNull()))

    return F.array_contains(F.aggregate(near, F.array(F.length(letters)), step), 0)


def glosses(text: Column) -> Column:
    """Acronyms in brackets, each with the text before it: array of (before, tokens)."""
    inside = F.regexp_extract_all(text, F.lit(GLOSS), 1)
    between = F.split(text, GLOSS, -1)

    def one(tokens_: Column, i: Column) -> Column:
        # words of the brackets before count too; 40 pieces hold more words than any acronym has letters
        start = F.greatest(i - 39, F.lit(0))
        earlier = F.transform(F.slice(F.arrays_zip(between.alias("t"), F.concat(F.array(F.lit("")), inside).alias("g")), start + 1, i - start + 1), lambda p: F.concat(F.lit(" "), p["g"], F.lit(" "), p["t"]))
        return F.struct(F.array_join(earlier, "").alias("before"), F.split(F.trim(tokens_), r"[\s-]+").alias("tokens"))

    return F.transform(inside, one)


def letters_of(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "[^A-Za-z]", ""))


def has_expansion(text: Column, found: Column, token: Column, versions: bool = True) -> Column:
    """Whether the text spells the token out before or after it in brackets. found: glosses(text). versions: whether a
    version before the brackets is no word of the expansion."""
    letters, digits = letters_of(token), F.regexp_replace(token, "[^0-9]", "")

    def before(g: Column) -> Column:
        cut = F.rtrim(F.regexp_replace(g["before"], VERSION, "") if versions else g["before"])
        cut = F.when((digits != "") & F.endswith(cut, digits), F.substring(cut, F.lit(1), F.length(cut) - F.length(digits))).otherwise(cut)
        return F.array_contains(g["tokens"], token) & initials_match(gloss_words(cut), F.array_join(F.transform(g["tokens"], letters_of), ""))

    after = F.regexp_extract_all(text, F.concat(F.lit(r"(?<![\w-])"), token, F.lit(r"\s*\(([^()]+)\)")), 1)
    spelled = F.exists(after, lambda a: once(gloss_words(a), lambda w: (F.size(w) > 0) & initials_match(w, letters)))
    return (F.length(letters) >= 2) & (F.exists(found, before) | spelled)


def unresolved_acronyms(text: Column) -> Column:
    """Acronyms that the text neither spells out nor defines in words, once each, in order."""
    found = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ACRONYM})"), 1)), F.array(*[F.lit(t) for t in KNOWN_TOKENS]))

    def explained(token: Column, given: Column) -> Column:
        defined = F.concat(F.lit(r"(?i)(?<!\w)"), token, F.lit(rf"[\w-]*\s+(?:{GLOSS_VERBS})\s+\S"))
        named = F.concat(F.lit(rf"(?i)(?:{NAMED_AS})"), token, F.lit(r"(?![\w-])"))
        gene = F.concat(F.lit(GENE_PREFIX), token, F.lit(r"(?![A-Za-z])"))
        return has_expansion(text, given, token) | F.regexp(text, defined) | F.regexp(text, named) | F.regexp(text, gene)

    # glosses are looked for only where there are acronyms
    open_ = lambda given: F.filter(found, lambda t: ~explained(t, given))
    return F.when(F.size(found) > 0, once(glosses(text), open_)).when(text.isNotNull(), F.array().cast("array<string>"))


def requires_context(text: Column) -> Column:
    """Whether a text points at something of its study: a station, a binomial cut short, an acronym."""
    return text.rlike(REFERENT) | text.rlike(BINOMIAL) | (F.size(unresolved_acronyms(text)) > 0)


def names_a_referent(context: Column) -> Column:
    """Whether a context has a word of its own, beside directions, articles and kinds of places."""
    words = F.regexp_extract_all(F.lower(context), F.lit(r"(?U)(\p{L}[\w-]*)"), 1)
    return F.exists(words, lambda w: ~among(w, CONTEXT_FILLER))
