"""Quality rules: base counts, and the divergence of a document from its language.

Each document's histograms of character classes and of its language's common short words are
held against those of the language by Jensen-Shannon distance. A language's references come
from all its documents that pass the base rules: the median share of each character class, so
that a minority of junk doesn't move them, and the pooled shares of the common words. Short
texts are not judged by divergence, and the limit for words allows for chance in few words;
a text without a single common word fails wherever some were to be expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table, words_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COMMON = 32
#: Common words have at most so many characters.
SHORT = 4
#: Texts of fewer words aren't judged by divergence.
MIN_WORDS = 40
#: Limits for the two distances; what chance adds shrinks with the square root of the words.
CLASS_LIMIT, CLASS_NOISE = 0.17, 0.6
WORD_LIMIT, WORD_NOISE = 0.20, 2.4
#: A text without any common word fails where its language lets expect so many.
EXPECTED = 6
#: Shares of character classes are told apart to so many parts of one.
BINS = 10_000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of words that occurs twice or more in the text.

    Hash codes of the windows only tell the texts without any; the others compare words.
    """
    n = F.size(words)

    def each(of) -> Column:
        return F.transform(F.sequence(F.lit(0), n - window), of)

    codes = each(lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    # Outside of a lambda function Spark compiles the set of codes.
    distinct = F.size(F.array_distinct(codes)) == n - window + 1
    texts = each(lambda i: F.array_join(F.slice(words, i + 1, F.lit(window)), " "))
    return F.when(n < window, F.lit(0)).when(distinct, F.lit(0)).otherwise(F.transform(F.array(texts), lambda c: _covered(c, window))[0])


def _covered(windows: Column, window: int) -> Column:
    in_order = F.array_sort(F.transform(windows, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

    def places(s: Column) -> Column:
        m = F.size(s)
        at = F.filter(
            F.sequence(F.lit(0), m - 1),
            lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["c"] == s[k]["c"])) | ((k < m - 1) & (s[F.least(k + 1, m - 1)]["c"] == s[k]["c"])),
        )
        return F.array_sort(F.transform(at, lambda k: s[k]["i"]))

    def count(p: Column) -> Column:
        gaps = F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.array(F.lit(2**31 - 1))), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    return F.transform(F.array(in_order), lambda s: F.transform(F.array(places(s)), count)[0])[0]


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _shares(*counts: str) -> Column:
    total = F.greatest(sum(F.col(c) for c in counts), F.lit(1))
    return F.array(*[F.col(c) / total for c in counts])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b)) / 2).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def occurrences(words: Column, wanted: Column) -> Column:
    """How often each of the distinct ``wanted`` words occurs; what is counted is not looked at again."""
    start = F.struct(words.alias("rest"), F.array().cast("array<int>").alias("sizes"))

    def without(acc: Column, c: Column) -> Column:
        return F.struct(F.array_remove(acc["rest"], c).alias("rest"), F.concat(acc["sizes"], F.array(F.size(acc["rest"]))).alias("sizes"))

    sizes = F.aggregate(wanted, start, without, lambda acc: F.concat(acc["sizes"], F.array(F.size(acc["rest"]))))
    # A one-element array binds a value to a name, so that it is worked out once.
    return F.transform(F.array(sizes), lambda x: F.transform(wanted, lambda c, k: F.get(x, k) - F.get(x, k + 1)))[0]


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules and of character classes; null is no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("q_text", text).withColumn("q_words", words_of(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD))
    # Neither letters nor white space: next to nothing in most texts, so that it is cheap to search again.
    rows = rows.withColumn("q_lines", lines).withColumn("q_signs", F.regexp_replace("q_text", rf"[\p{{L}}{SPACE[1:-2]}]+", ""))
    rows = rows.withColumn("q_word_chars", F.length(F.array_join("q_words", "")).cast("long")).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "q_words",
        F.size("q_words").cast("long").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        _left(F.col("q_signs"), f"[^{SYMBOLS}]+").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("q_words")).cast("long").alias("n_repeat_words"),
        F.length("q_text").cast("long").alias("q_chars"),
        (F.col("q_word_chars") - F.length("q_signs")).alias("q_letters"),
        _left(F.col("q_text"), r"\P{Lu}+").alias("q_upper"),
        _left(F.col("q_signs"), r"[^0-9]+").alias("q_digit"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def common_words(docs: DataFrame, lang: Column, text_col: str = "text", count: int = COMMON, short: int = SHORT) -> DataFrame:
    """``lang, common``: the most frequent words of at most ``short`` characters, by language."""
    brief = F.filter(words_of(F.lower(F.coalesce(F.col(text_col), F.lit("")))), lambda w: F.length(w) <= short)
    counts = docs.select(lang.alias("lang"), F.explode(brief).alias("word")).groupBy("lang", "word").count()
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("nth") <= count)
    return ranked.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("common"))


def class_medians(features: DataFrame) -> DataFrame:
    """``q_lang, m``: the lower median of each class's share, taken to 1 in ``BINS``.

    Shares are counted by bin, so that it is exact however the rows are dealt, and what a
    task holds is bounded by the bins.
    """
    bins = features.select("q_lang", F.posexplode(F.transform("classes", lambda x: F.round(x * BINS).cast("int"))).alias("k", "bin")).groupBy("q_lang", "k", "bin").count()
    whole = Window.partitionBy("q_lang", "k")
    placed = bins.withColumn("below", F.sum("count").over(whole.orderBy("bin"))).withColumn("n", F.sum("count").over(whole))
    middle = placed.groupBy("q_lang", "k").agg(F.min(F.when(2 * F.col("below") >= F.col("n"), F.col("bin") / BINS)).alias("m"))
    return middle.groupBy("q_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("m"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, ``class_distance``, ``word_distance`` and ``kept``: one row per row.

    A null text has no words and fails the base rules, as does any text of under ten words.
    Each language has references of its own, and so has null. A language none of whose
    documents passes the base rules has no reference: its distances are null and the base
    rules decide alone. Repeated rows and null ids each give a row.
    """
    lang = F.col(lang_col)
    top = materialise(common_words(docs, lang, text_col))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("q_lang"))
    counted = base_counts(narrow).join(top.withColumnRenamed("lang", "t_lang"), F.col("q_lang").eqNullSafe(F.col("t_lang")), "left")
    brief = F.split(F.lower(F.array_join(F.filter("q_words", lambda w: F.length(w) <= SHORT), " ")), " ")
    features = materialise(
        counted.withColumn("q_brief", brief)
        .withColumn("q_lower", F.col("q_letters") - F.col("q_upper"))
        .withColumn("q_space", F.col("q_chars") - F.col("word_chars"))
        .withColumn("q_other", F.col("word_chars") - F.col("q_letters") - F.col("q_digit") - F.col("n_symbols"))
        .select(
            "id", "q_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            _shares("q_lower", "q_upper", "q_digit", "q_space", "n_symbols", "q_other").alias("classes"),
            occurrences(F.col("q_brief"), F.col("common")).alias("seen"),
        )
    )
    passed = features.where("NOT base_failed")
    medians = class_medians(passed)
    medians = medians.select(F.col("q_lang").alias("m_lang"), F.transform("m", lambda x: x / F.aggregate("m", F.lit(1e-12), lambda a, y: a + y)).alias("class_ref"))
    pooled = passed.groupBy("q_lang").agg(F.array(*[F.sum(F.get("seen", F.lit(k))) for k in range(COMMON)]).alias("s"), F.sum("n_words").alias("n"))
    pooled = pooled.select(F.col("q_lang").alias("p_lang"), _with_rest(F.filter("s", lambda x: x.isNotNull()), F.col("n")).alias("word_ref"))
    references = materialise(medians.join(pooled, F.col("m_lang").eqNullSafe(F.col("p_lang"))).select(F.col("m_lang").alias("r_lang"), "class_ref", "word_ref"))
    judged = features.join(references, F.col("q_lang").eqNullSafe(F.col("r_lang")), "left")
    judged = judged.withColumn("class_distance", js_distance(F.col("classes"), F.col("class_ref"))).withColumn("word_distance", js_distance(_with_rest(F.col("seen"), F.col("n_words")), F.col("word_ref")))
    expected = F.col("n_words") * (1 - F.element_at("word_ref", -1))
    none = (F.aggregate("seen", F.lit(0), lambda a, x: a + x) == 0) & (expected >= EXPECTED)
    far = (F.col("n_words") >= MIN_WORDS) & (none | (F.col("class_distance") > CLASS_LIMIT + CLASS_NOISE / F.sqrt("n_words")) | (F.col("word_distance") > WORD_LIMIT + WORD_NOISE / F.sqrt("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def _with_rest(counts: Column, total: Column) -> Column:
    shares = F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
