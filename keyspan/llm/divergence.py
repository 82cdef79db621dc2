"""Quality rules by distribution divergence, in DataFrame functions only.

Each language's reference is a histogram of character classes and one of its commonest
words, from all documents of the corpus.  A document is compared with its
language's reference by Jensen-Shannon distance (square root of the divergence, base
2, so 0 to 1) on both histograms and rejected where one is too far.  Short texts
scatter, so the limit on words widens with 1 / sqrt(n_words), and texts under
``min_words`` pass by the guard.  A language with less than ``min_share`` of the corpus has no
reference of its own: its documents are held against the character classes of all
documents, and not against words.  The base rules (too few words, too many repeated
windows) come first.

Histograms: characters of words as upper-case letters, other letters, digits,
symbols `[#*$%&|<>]` and the rest; words as the ``common`` commonest of the language
and the rest.  A text is split once for the commonest words and once to be measured; what
the verdict needs of it are few numbers, which are written (beside the document's columns,
where those are wanted) before references and verdicts are made of them.  A reference
is kept for languages with ``min_share`` of all documents, so there are 1 / min_share of
them at most, and they may be broadcast.

Windows are compared by their 64-bit XXH64; where windows of a document share a hash but
not their words, that document's are compared by the words themselves.

Results for edge cases: a null or empty text has zero counts and fails the base rule;
null languages are a language of their own; repeated rows give repeated rows (and
count each time in the reference); an empty table gives an empty result; columns other
than doc_id, text and lang are carried along only with ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyspan.llm.common import written

#: The characters that separate words, and the symbols counted.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common: int = 20
    min_share: float = 0.001
    witness_share: float = 0.2
    char_limit: float = 0.27
    word_limit: float = 0.14
    word_scatter: float = 2.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANK_RUN), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(words: Column, window_hash: Callable[..., Column] = F.xxhash64) -> Column:
    """Words that stand in a 3-word window found twice or more."""

    heads = F.slice(words, 1, F.size(words) - 2)
    spelled = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])

    def sorted_windows(keys: Column) -> Column:
        return F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def total(again: Column) -> Column:
        """Words of the windows (x, i) in ``again``."""
        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).alias("last"))
        step = lambda a, q: F.struct((a["c"] + F.least(F.lit(3), q - a["last"])).cast("long").alias("c"), q.alias("last"))
        return F.aggregate(F.sort_array(F.transform(again, lambda v: v["i"])), start, step, lambda a: a["c"])

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda v, j: ((j > 0) & (F.get(s, j - 1)["x"] == v["x"])) | F.coalesce(F.get(s, j + 1)["x"] == v["x"], F.lit(False)))

    def checked(again: Column) -> Column:
        """Neighbours under one hash have to be one window."""
        clash = F.exists(
            F.transform(again, lambda v, j: (j > 0) & (F.get(again, j - 1)["x"] == v["x"]) & (spelled(F.get(again, j - 1)["i"]) != spelled(v["i"]))),
            lambda x: F.coalesce(x, F.lit(False)),
        )
        exact = _let(sorted_windows(F.transform(heads, lambda _, i: spelled(i))), lambda s: total(repeated(s)))
        return F.when(clash, exact).otherwise(total(again))

    def covered(hashes: Column) -> Column:
        whole = _let(_let(sorted_windows(hashes), repeated), checked)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(whole)

    hashes = F.transform(heads, lambda x, i: window_hash(x, words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def _duplicate_lines(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return _let(filled, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def common_words(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """ref_lang and common_words (by the number of documents that have them) of each larger language."""
    rows = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("ref_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = rows.groupBy("ref_lang").agg(F.count("*").alias("docs"))
    total = sizes.agg(F.sum("docs").alias("all_docs"))
    larger = sizes.crossJoin(F.broadcast(total)).where(F.col("docs") >= rules.min_share * F.col("all_docs")).select("ref_lang")  # one row beside each language
    counted = rows.select("ref_lang", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    # Spark keeps the first ranks within each task before it shuffles them.
    place = F.row_number().over(W.partitionBy("ref_lang").orderBy(F.desc("n"), "word"))
    top = counted.select("ref_lang", "word", place.alias("place")).where(F.col("place") <= rules.common)
    words = top.groupBy("ref_lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda v: v["word"]).alias("common_words"))
    return words.join(larger, "ref_lang", "left_semi")


def _measures(text: Column, common: Column) -> Column:
    """All that is counted in a text, from one list of its words."""

    def marks(rest: Column) -> Column:
        return F.struct(
            F.length(rest).alias("all"), (F.length(rest) - F.length(_without(rest, SYMBOLS))).alias("symbols"),
            F.length(F.regexp_replace(rest, "[^0-9]+", "")).alias("digits"),
        )

    def characters(solid: Column) -> Column:
        return F.struct(
            F.length(solid).alias("all"), F.length(F.regexp_replace(solid, "[^\\p{Lu}]+", "")).alias("upper"),
            _let(F.regexp_replace(solid, "\\p{L}+", ""), marks).alias("marks"),
        )

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeat_words(words).alias("n_repeat_words"),
            _let(F.array_join(words, ""), characters).alias("c"),
            F.transform(common, lambda w: (F.size(words) - F.size(F.array_remove(words, w))).cast("long")).alias("common"),
        )

    return _let(_words(text), of)


def measured(df: DataFrame, words: DataFrame, keep: bool = False) -> DataFrame:
    """One row of counts for each document, with its id or (``keep``) all its columns as ``own``.

    ``words`` has at most 1 / min_share rows and is broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if keep else F.struct("doc_id")
    lines = _duplicate_lines(F.col("text"))
    rows = df.select(own.alias("own"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("ref_lang"), text.alias("text")).join(F.broadcast(words), "ref_lang", "left")
    rows = rows.select("own", "ref_lang", "common_words", lines.alias("n_dup_lines"), _measures(F.col("text"), F.col("common_words")).alias("m"))
    c = F.col("m.c")
    classes = F.array(
        *(x.cast("long") for x in (c["upper"], c["all"] - c["marks"]["all"] - c["upper"], c["marks"]["digits"], c["marks"]["symbols"], c["marks"]["all"] - c["marks"]["digits"] - c["marks"]["symbols"]))
    )
    return rows.select(
        "own", "ref_lang", "common_words", F.col("m.n_words").alias("n_words"), c["all"].cast("long").alias("word_chars"),
        c["marks"]["symbols"].cast("long").alias("n_symbols"), "n_dup_lines", F.col("m.n_repeat_words").alias("n_repeat_words"),
        classes.alias("classes"), F.col("m.common").alias("common"),
    )


def references(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """ref_lang, common_share and class_share (arrays) of each language with common words; null as language: class_share of all.

    Shares are means over the language's documents, so that a long one counts as any
    other; too short documents, and those that one common word fills by more than
    ``witness_share``, say nothing of the language.
    """
    seen = counts.where(
        (F.col("n_words") >= rules.min_words) & F.coalesce(F.array_max("common") <= rules.witness_share * F.col("n_words"), F.lit(True))
        & (F.col("word_chars") > 0)
    )
    classes = lambda df: df.agg(*(F.avg(F.col("classes")[k] / F.col("word_chars")).alias(f"c{k}") for k in range(5)))
    whole = classes(seen).select(
        F.lit(None).cast("string").alias("ref_lang"), F.lit(None).cast("array<double>").alias("common_share"),
        F.array(*(f"c{k}" for k in range(5))).alias("class_share")
    )
    means = seen.where(F.col("common").isNotNull()).groupBy("ref_lang").agg(
        F.max(F.size("common")).alias("size"),
        *(F.avg(F.get("common", F.lit(k)) / F.col("n_words")).alias(f"w{k}") for k in range(rules.common)),
        *(F.avg(F.col("classes")[k] / F.col("word_chars")).alias(f"c{k}") for k in range(5))
    )
    return means.select(
        "ref_lang", F.slice(F.array(*(f"w{k}" for k in range(rules.common))), F.lit(1), F.col("size")).alias("common_share"),
        F.array(*(f"c{k}" for k in range(5))).alias("class_share")
    ).unionByName(whole)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; what is missing to 1 is one more share."""

    def full(shares: Column) -> Column:
        return _let(shares, lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x)))))

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    halves = F.zip_with(full(p), full(q), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(halves, F.lit(0.0), lambda a, x: a + x) / 2))


def verdicts(counts: DataFrame, refs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Distances, base_failed and kept beside the counts. ``refs`` is bounded as ``words`` is."""
    rows = counts.join(F.broadcast(refs.where("ref_lang is not null")), "ref_lang", "left")
    every = refs.where("ref_lang is null").select(F.col("class_share").alias("all_class_share"))  # one row
    rows = rows.crossJoin(F.broadcast(every)).withColumn("class_share", F.coalesce("class_share", F.when(F.col("all_class_share")[0].isNotNull(), F.col("all_class_share"))))
    n, chars = F.col("n_words"), F.col("word_chars")
    tested = n >= rules.min_words
    rows = rows.withColumn(
        "char_distance",
        F.when(
            tested & F.col("class_share").isNotNull() & (chars > 0),
            js_distance(F.transform("classes", lambda x: x / chars), F.col("class_share")),
        ),
    )
    rows = rows.withColumn("word_distance", F.when(tested & F.col("common_share").isNotNull(), js_distance(F.transform("common", lambda x: x / n), F.col("common_share"))))
    far = F.coalesce(F.col("char_distance") > rules.char_limit, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.word_limit + rules.word_scatter / F.sqrt("n_words"), F.lit(False),
    )
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~far})


def quality_rules(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each document: doc_id, the counts, base_failed, kept, and both distances."""
    words = written(common_words(df, rules), "words")
    counts = written(measured(df, words), "counts")
    out = verdicts(counts, references(counts, rules), rules)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(F.col("own.doc_id"), *made, F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def kept_documents(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns."""
    words = written(common_words(df, rules), "words")
    counts = written(measured(df, words, keep=True), "measured")
    return verdicts(counts, references(counts, rules), rules).where("kept").select("own.*")
