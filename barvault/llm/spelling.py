"""Spelling variants of words, by pivotal grams.

Two words one edit apart share at least one of any two disjoint bigrams of either word, at nearly the same place, since an
edit touches no two disjoint bigrams. With all bigrams in one order, rarest first, a word's *prefix* is its first three
(and those that tie with the third): two of them are always disjoint, and the cheapest such two are its *pivots*. Of two
near words, take the one whose prefix ends earlier in the order: the pivot it shares lies in the other's prefix. So only
pivots are matched with prefixes, by place, length and the side of the word that the edit leaves alone, and what meets is
verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barvault.llm.support import ascii_lower
from barvault.operators.joins import join_unique
from barvault.session import materialise

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 5
MIN_COUNT = 3
NOISE = 97
RATIO = 2

_GRAM = 2
_PREFIX = 3  # bigrams touched by one edit, and one more


def _without(word: Column, at: Column) -> Column:
    """The word without its code point number ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """(word) for every run of letters in every whole text, with A-Z lower-cased.

    A run loses one code point, number h % length, if ``noise`` divides h, the CRC-32 of ``<key>:<run>``. A null text has
    no runs; a null key reads as nothing in front of the colon.
    """
    lowered = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % noise == 0, _without(F.col("run"), place)).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences; counts are combined before the shuffle."""
    long = words.where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _grams(word: Column) -> Column:
    """The bigrams of a word with their places."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word) - (_GRAM - 1)),
        lambda i: F.struct(F.substring(word, i, F.lit(_GRAM)).alias("gram"), i.alias("at")),
    )


def _pivots(prefix: Column) -> Column:
    """The places of the two disjoint grams of least total count out of (rank, at, often), the first one first.

    Dynamic programming along the places: ``one`` holds the grams passed, ``two`` the cheapest pair that ends so far;
    a gram is added to the cheapest one that it does not overlap.
    """
    gram = "struct<often:bigint,at:int>"
    nothing = F.struct(
        F.array().cast(f"array<{gram}>").alias("one"),
        F.lit(None).cast("struct<cost:bigint,a:int,b:int>").alias("two"),
    )

    def step(state: Column, x: Column) -> Column:
        own = F.struct(x["often"].alias("often"), x["at"].alias("at"))
        apart = F.array_min(F.filter(state["one"], lambda o: o["at"] + _GRAM <= x["at"]))
        pair = F.struct((apart["often"] + x["often"]).alias("cost"), apart["at"].alias("a"), x["at"].alias("b"))
        better = apart.isNotNull() & (state["two"].isNull() | (pair["cost"] < state["two"]["cost"]))
        return F.struct(
            F.concat(state["one"], F.array(own)).alias("one"), F.when(better, pair).otherwise(state["two"]).alias("two")
        )

    by_place = F.array_sort(prefix, lambda a, b: a["at"] - b["at"])
    return F.aggregate(by_place, nothing, step)["two"]


def gram_index(vocab: DataFrame) -> DataFrame:
    """(word, n, size, prefix, limit, a, b) per word: the places of its prefix, the rank of the last gram of that in the
    order of all grams, and the places of its pivots."""
    places = vocab.select("word", "n", F.explode(_grams(F.col("word"))).alias("g")).select("word", "n", "g.gram", "g.at")
    often = places.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # two letters out of 90: at most 8,100 rows to number in one task and to broadcast
    ranks = often.withColumn("rank", F.row_number().over(Window.orderBy("often", "gram")))
    ranked = places.join(F.broadcast(ranks), "gram")
    ordered = ranked.groupBy("word", "n").agg(
        F.sort_array(F.collect_list(F.struct("rank", "at", "often"))).alias("grams")
    )
    limit = F.element_at("grams", _PREFIX)["rank"]
    prefix = F.transform(F.filter("grams", lambda g: g["rank"] <= limit), lambda g: g["at"])
    return ordered.select(
        "word", "n", F.length("word").alias("size"), prefix.alias("prefix"), limit.alias("limit"),
        _pivots(F.slice("grams", 1, _PREFIX)).alias("_p"),
    ).select("word", "n", "size", "prefix", "limit", "_p.a", "_p.b")


def _left(word: Column, count: Column) -> Column:
    return F.substring(word, F.lit(1), count)


def _right(word: Column, start: Column) -> Column:
    return F.substring(word, start, F.length(word))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all words (of at least four letters) exactly one edit apart, in both directions.

    An edit before the second pivot leaves that pivot and all behind it as they are; any other edit leaves the first
    pivot and all before the second one. So the pivot is matched together with the end of the word from it on, or with the
    start of the word up to it, which also fixes its place. Of the part that holds the edit, one half must be the same.
    """
    index = materialise(gram_index(vocab))
    word, size, a, b = F.col("word"), F.col("size"), F.col("a"), F.col("b")
    middle = b - 1 + F.ceil((size - b + 1) / 2).cast("int")
    before = F.floor((b - 1) / 2).cast("int")
    start = F.struct(
        F.lit(0).alias("side"), _left(word, a + 1).alias("part"), _left(word, b - 1).alias("stem"),
        _left(word, middle).alias("front"), _right(word, middle + 1).alias("back"),
    )
    end = F.struct(
        F.lit(1).alias("side"), _right(word, b).alias("part"), F.lit("").alias("stem"),
        _left(word, before).alias("front"), _right(word, before + 1).alias("back"),
    )
    asked = index.select("word", "n", "limit", "size", F.explode(F.array(start, end)).alias("k")).select(
        "word", "n", "limit", "k.*", F.explode(F.array(size - 1, size, size + 1)).alias("size")
    )
    other, at = F.col("other"), F.col("at")
    parts = F.array(
        F.struct(F.lit(0).alias("side"), _left(other, at + 1).alias("part")),
        F.struct(F.lit(1).alias("side"), _right(other, at).alias("part")),
    )
    held = (
        index.select(word.alias("other"), F.col("n").alias("other_n"), "size", F.col("limit").alias("other_limit"), F.explode("prefix").alias("at"))
        .select("other", "other_n", "size", "other_limit", F.explode(parts).alias("k"))
        .select("other", "other_n", "size", "other_limit", "k.side", "k.part")
    )
    x, y = asked.alias("x"), held.alias("y")
    other = F.col("y.other")
    met = x.join(
        y,
        (F.col("x.part") == F.col("y.part"))
        & (F.col("x.size") == F.col("y.size"))
        & (F.col("x.side") == F.col("y.side"))
        & (F.col("x.limit") <= F.col("y.other_limit"))
        & other.startswith(F.col("x.stem"))
        & (other.startswith(F.col("x.front")) | other.endswith(F.col("x.back")))
        & (F.col("x.word") != other)
        & (F.levenshtein(F.col("x.word"), other, 1) == 1),
    ).select("x.word", "x.n", "y.other", "y.other_n")
    return met.union(met.select("other", "other_n", "word", "n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word along (word, form).

    Pointers are doubled: each pass is written to the shared folder and halves what is left of every path. A form is at
    least ``ratio`` times as frequent as its word, so paths have no circles and are short.
    """
    tied = materialise(forms.select("word", F.col("form").alias("root")))
    while not tied.join(tied.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = tied.select(F.col("word").alias("root"), F.col("root").alias("next"))
        tied = materialise(join_unique(tied, further, ["root"]).select("word", F.coalesce("next", "root").alias("root")))
    return tied


def spelling_groups(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n, the
    smallest of equals in code-point order, if that n is at least ``ratio`` times the word's, else null; the root is the
    last word along the forms. Words must be distinct; an empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2")
    vocab = materialise(vocab.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_pairs(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = join_unique(vocab, near, ["word"])
    enough = -F.col("best.less") >= F.col("n") * ratio
    found = materialise(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return join_unique(found, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_spellings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    noise: int = NOISE, ratio: int = RATIO,
) -> DataFrame:
    """The spelling groups of all words of the whole texts; see ``words_of``, ``vocabulary`` and ``spelling_groups``.

    Null texts, empty tables and further columns do no harm; repeated rows count as often as they are there.
    """
    if min_length < _PREFIX + 1:
        raise ValueError(f"words must have at least {_PREFIX + 1} letters")
    return spelling_groups(vocabulary(words_of(docs, key, text, noise), min_length, min_count), ratio)
