"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, langs=None):
    """documents with these texts; extra columns have names that operators use inside."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "src0", len(t) if t is not None else None) for i, (t, lang) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    names = "n h kind rep component start n_tokens piece score block text_ lines item_id row ends copies gone again r th g j f k own kept fd fth fj _lines _copies _ends _gone _r m x y salt classes spans passages node u v a b z held_out lang_pred license saved rank query_id region shard".split()
    return df.withColumns({name: F.lit("x") for name in names})


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Nulls, emptiness, blanks, one word, odd letters, special strings, long words, a repeated row's text.
ODD = [None, "", " ", "\n\n", "word", "É ǅ ß ΑΣ", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "word", "a\x1cb\tc\x0bd", "😀 👍🏽 ﬁ", "² Ⅷ 12"]
