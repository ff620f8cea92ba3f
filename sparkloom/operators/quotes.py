"""Quotes found again in the texts they were taken from, and sentences that spell out an acronym.

Quotes: each quote is looked for in all chunks, first as it stands, else with other white space between its words. Quote
and chunk meet by hashes of windows of whole words within the quote, taken where its rarest window stands; what meets
is compared byte by byte, so nothing else is found. Quotes with no whole word inside (one or two words) have no window;
an automaton of a bounded block of them reads each chunk once. Only hashes are shuffled with the windows, each text
once with the pairs.

Chunks without an id or a text hold nothing; chunks that repeat count once, and so do quotes that repeat. A blank quote
is "blank", a null one or one with another hash than stated is "invalid", one that no chunk holds is "unbound".
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.display import GLUE_WORDS
from sparkloom.functions.text import once, sentences

#: Words of a window, and short quotes of one automaton.
WINDOW, BLOCK = 3, 20_000

# How an expansion and its acronym stand together, and the least sentence that is shown.
FORWARD = r"((?:[A-Za-z][\w‐-]*[ \t\n]+){0,9}[A-Za-z][\w‐-]*)[ \t\n]*\(\s*([A-Z][A-Z0-9]{1,7})\s*\)"
REVERSE = r"(?<![\w-])([A-Z][A-Z0-9]{1,7})\s*\(\s*([A-Za-z][^()\n]{2,120}?)\s*\)"
LEAST_SENTENCE = 16
#: What parts words.
BLANKS = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS + "+"), lambda w: w != "")


def windows(tokens: Column, size: int) -> Column:
    """Hashes of all runs of size words, once each."""
    run = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    whole = lambda w: F.array_distinct(F.slice(run(w), F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(0))))
    return once(tokens, whole)


def spaced(quote: Column) -> Column:
    """A pattern for the quote with any white space between its words, between other words."""
    tokens = F.transform(words(quote), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    trimmed = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    opens = F.when(trimmed.rlike(r"(?U)^\w"), r"(?<![\w])").otherwise("")
    closes = F.when(trimmed.rlike(r"(?U)\w$"), r"(?![\w])").otherwise("")
    return F.concat(F.lit("(?U)"), opens, F.array_join(tokens, r"\s+"), closes)


def found(text: Column, quote: Column) -> Column:
    """(start, text, kind) of the first place of a quote in a text; null if it has none."""
    exact = once(F.instr(text, quote), lambda k: F.when(k > 0, F.struct((k - 1).alias("start"), quote.alias("text"), F.lit("exact").alias("kind"))))

    def loosely(pattern: Column) -> Column:
        start = F.regexp_instr(text, pattern) - 1
        return F.when(start >= 0, F.struct(start.alias("start"), F.regexp_substr(text, pattern).alias("text"), F.lit("whitespace_equivalent").alias("kind")))

    # patterns are built only where all words are there
    loose = F.when(F.forall(words(quote), lambda w: F.contains(text, w)), once(spaced(quote), loosely))
    return F.coalesce(exact, F.when(quote.rlike(r"(?U)\s"), loose))


def _pairs(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Quotes of three words or more with the chunks that may hold them: (quote, chunk_id)."""
    inner = F.slice(words(F.col("quote")), F.lit(2), F.size(words(F.col("quote"))) - 2)
    sized = quotes.select("quote", inner.alias("w")).withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    by_size = [F.when(F.col("size") == k, windows(F.col("w"), k)) for k in range(1, WINDOW + 1)]
    asked = sized.select("quote", "size", F.explode(F.coalesce(*by_size)).alias("key"))
    keyed = lambda k: F.transform(windows(F.col("w"), k), lambda h: F.struct(F.lit(k).alias("size"), h.alias("key")))
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # WINDOW at most
    if not sizes:
        return quotes.select("quote", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id")).limit(0)
    given = chunks.select("chunk_id", words(F.col("text")).alias("w")).select("chunk_id", F.inline(F.concat(*[keyed(k) for k in sorted(sizes)])))
    met = given.join(asked.select("size", "key").distinct(), ["size", "key"], "left_semi").persist(StorageLevel.DISK_ONLY)  # of the texts, what quotes hold too
    times = met.groupBy("size", "key").agg(F.count("*").alias("times"))
    rarest = asked.join(times, ["size", "key"]).groupBy("quote").agg(F.count("*").alias("n"), F.min(F.struct("times", "size", "key")).alias("least"))
    every = asked.groupBy("quote").agg(F.count("*").alias("all"))
    whole = rarest.join(every, "quote").filter("n = all").select("quote", "least.size", "least.key")  # else a window is nowhere
    return met.join(whole, ["size", "key"]).select("quote", "chunk_id")


def _holders(short: list[str], chunks: DataFrame) -> DataFrame:
    """Short quotes with the chunks that hold them but for white space: (quote, chunk_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, asked = ahocorasick.Automaton(), {}
        for q in short:
            asked.setdefault(" ".join(q.split()), []).append(q)
        for flat in asked:
            automaton.add_word(flat, flat)
        automaton.make_automaton()
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for flat in {f for _, f in automaton.iter(" ".join(text.split()))}:
                    at += [i] * len(asked[flat])
                    hits += asked[flat]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), batch.column("chunk_id").take(pa.array(at, pa.int64()))], ["quote", "chunk_id"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"quote string, chunk_id {kind}")


def locate(quotes: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where each quote stands. quotes: quote_id, quote, quote_sha256; chunks: chunk_id, place, text. Of the chunks that
    hold a quote the first by place (then chunk_id) is taken: chunk_id, start_offset, end_offset (code points), text,
    text_sha256, match_kind; and status."""
    chunks = chunks.filter("chunk_id is not null and text is not null").select("chunk_id", "place", "text")
    valid = F.coalesce((F.col("quote") != "") & (F.sha2("quote", 256) == F.col("quote_sha256")), F.lit(False))
    blank = valid & ~F.col("quote").rlike(r"(?U)\S")
    known = quotes.filter(valid & ~blank).select("quote").distinct()
    short = F.size(words(F.col("quote"))) < 3
    pairs = _pairs(known.filter(~short), chunks)
    few = known.filter(short)
    parts = -(-few.count() // block)
    for part in range(parts):
        piece = [r["quote"] for r in few.filter(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part).collect()]  # about block strings of two words
        pairs = pairs.unionByName(_holders(piece, chunks))
    hits = pairs.distinct().join(chunks, "chunk_id").withColumn("at", found(F.col("text"), F.col("quote")))
    first = hits.filter("at is not null").groupBy("quote").agg(F.min_by(F.struct("chunk_id", "at"), F.struct("place", "chunk_id")).alias("hit"))
    end = F.col("hit.at.start") + F.length("hit.at.text")
    status = F.when(~valid, "invalid").when(blank, "blank").when(F.col("hit").isNull(), "unbound").otherwise("located")
    return quotes.select("quote_id", "quote", "quote_sha256").join(first, "quote", "left").select(
        "quote_id",
        status.alias("status"),
        F.when(status == "located", F.col("hit.chunk_id")).alias("chunk_id"),
        F.when(status == "located", F.col("hit.at.start").cast("long")).alias("start_offset"),
        F.when(status == "located", end.cast("long")).alias("end_offset"),
        F.when(status == "located", F.col("hit.at.text")).alias("text"),
        F.when(status == "located", F.sha2("hit.at.text", 256)).alias("text_sha256"),
        F.when(status == "located", F.col("hit.at.kind")).alias("match_kind"),
    )


def resolves(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a quote is what stands between two offsets of a text; false for nulls and offsets beyond it."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text)) & (quote != "")
    return F.coalesce(inside & (F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == quote), F.lit(False))


def spells_out(expansion: Column, token: Column) -> Column:
    """Whether an expansion may stand for a token: its last words begin with the letters, or an earlier one of as many
    words and one more with the first letter. Glue words are left out unless there are no others."""
    letters = F.lower(F.regexp_replace(token, "[^A-Za-z]", ""))
    parts = F.filter(F.split(F.lower(expansion), r"(?U)[\s/‐-―-]+"), lambda w: w != "")
    own = F.filter(parts, lambda w: ~w.isin(*GLUE_WORDS))
    firsts = F.array_join(F.transform(F.when(F.size(own) > 0, own).otherwise(parts), lambda w: F.substring(w, 1, 1)), "")

    def fits(initials: Column, c: Column) -> Column:
        n = F.length(initials)
        near = F.substring(initials, F.greatest(n - F.length(c) - 1, F.lit(1)), F.least(n - 1, F.length(c) + 1))
        return (c != "") & (F.endswith(initials, c) | ((n > 1) & F.contains(near, F.substring(c, 1, 1))))

    return F.coalesce(once(firsts, lambda i: once(letters, lambda c: fits(i, c))), F.lit(False))


def gloss_index(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """For each group (keys) and token the first sentence that spells it out, by place, chunk and position in it.
    chunks: the keys, chunk_id, place, text. Glosses in sentences of fewer than 16 characters are passed over; a gloss
    over a sentence's end is none. Texts are read sentence by sentence, and only those with brackets."""
    spans = chunks.filter(F.contains("text", F.lit("("))).select(*keys, "chunk_id", "place", "text", F.explode(sentences("text")).alias("s"))
    sentence = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = spans.select(*keys, "chunk_id", "place", F.col("s.start").alias("start"), sentence.alias("sentence")).filter(F.contains("sentence", F.lit("(")) & (F.length("sentence") >= LEAST_SENTENCE))
    pair = lambda pattern, token, words_: F.zip_with(F.regexp_extract_all("sentence", F.lit(pattern), token), F.regexp_extract_all("sentence", F.lit(pattern), words_), lambda t, w: F.struct(t.alias("token"), w.alias("expansion")))
    glosses = rows.select("*", F.inline(F.concat(pair(FORWARD, 2, 1), pair(REVERSE, 1, 2))))
    good = glosses.filter(spells_out(F.col("expansion"), F.col("token")) & F.col("token").rlike("[A-Z].*[A-Z]|[0-9]"))
    first = good.groupBy(*keys, "token").agg(F.min(F.struct("place", "chunk_id", "start", "sentence")).alias("g"))
    return first.select(*keys, "token", "g.chunk_id", F.col("g.start").cast("long").alias("start"), "g.sentence")


def definitions(displays: DataFrame, chunks: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """The sentences that explain what a display leaves open, at most `most` for a display, in the order of its tokens.
    displays: display_id, the keys, tokens (array). A display's sentence counts once, with its first token; equal tokens
    count once, and so do displays that repeat as whole rows."""
    asked = displays.select("display_id", *keys, F.posexplode("tokens").alias("turn", "token"))
    asked = asked.groupBy("display_id", *keys, "token").agg(F.min("turn").alias("turn"))
    met = asked.join(gloss_index(chunks, keys), [*keys, "token"])
    once_ = met.groupBy("display_id", *keys, "chunk_id", "start", "sentence").agg(F.min(F.struct("turn", "token")).alias("t"))
    turn = F.row_number().over(Window.partitionBy("display_id", *keys).orderBy("t.turn", "chunk_id", "start"))
    return once_.withColumn("rank", turn).filter(F.col("rank") <= most).select("display_id", *keys, "rank", "t.token", "chunk_id", "start", "sentence")
