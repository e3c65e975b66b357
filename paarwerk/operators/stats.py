"""Corpus statistics over a pair table: counts, vocabulary, correction rates and text types, with total rows.

Groups with a null key have no row of their own but count in the totals. All counts are long; averages and percentages
are rounded half to even at two places; percent texts are the rounded number with a sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WHOLE, ALL_CORRECTED, TOTAL = "WHOLE_CORPUS", "ALL_CORRECTED", "TOTAL"


def alpha_tokens(c: Column | str) -> Column:
    """Tokens of letters alone."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: x.rlike(r"^\p{L}+$"))


def rounded(c: Column) -> Column:
    return F.rint(c * 100) / 100


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def percent_text(part: Column | str, whole: Column | str) -> Column:
    return F.concat(rounded(ratio(part, whole) * 100).cast("string"), F.lit("%"))


def _with_total(df: DataFrame, key: str, aggregates: list[Column], total: str) -> DataFrame:
    """Counts per key, and one row named `total` over all rows, in one pass; without any row the total's counts are 0."""
    rolled = df.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates)
    named = rolled.where(F.col(key).isNotNull() | (F.col("_all") == 1)).withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key))).drop("_all")
    one = df.sparkSession.range(1).select(F.lit(total).alias(key), *[F.lit(0).cast("long").alias(c) for c in named.columns if c != key])
    # Of the named rows and the zero row, the larger of each name: the zero row stays only where there is nothing.
    return named.unionByName(one).groupBy(key).agg(*[F.max(c).alias(c) for c in named.columns if c != key])


def token_stats(pairs: DataFrame, columns: list[str], total: str, key: str = "corpus") -> DataFrame:
    """(key, words, unique_tokens) with a total row. Equal tokens of a group are counted together before anything is distinct."""
    pool = F.concat(*[alpha_tokens(c) for c in columns])
    each = pairs.select(key, F.explode(pool).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    by_key = each.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("unique_tokens"))
    whole = each.groupBy("token").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("unique_tokens"))
    return by_key.unionByName(whole.select(F.lit(total).alias(key), "words", "unique_tokens"))


def _corrected() -> list[Column]:
    return [F.count_if(F.coalesce("corrected", F.lit(False))).alias("corrected_pairs")]


def corpus_overview(pairs: DataFrame) -> DataFrame:
    """Pairs, sentences, words, vocabulary and correction rate per corpus and for all. A null `corrected` counts as left as is."""
    counts = _with_total(pairs, "corpus", [F.count(F.lit(1)).alias("n_sentence_pairs"), *_corrected()], WHOLE)
    joined = counts.join(token_stats(pairs, ["src", "tgt"], WHOLE), "corpus", "left")
    n, c = F.col("n_sentence_pairs"), F.col("corrected_pairs")
    words = F.coalesce("words", F.lit(0))
    return joined.select(
        "corpus", n, (n * 2).alias("n_sentences"), words.alias("words"), F.coalesce("unique_tokens", F.lit(0)).alias("unique_tokens"),
        rounded(ratio(words, n * 2)).alias("avg_words_per_sentence"), c, (n - c).alias("left_as_is"), percent_text(c, n).alias("corrected_pairs_pct"),
        (c * 2).alias("corrected_sentences"), ((n - c) * 2).alias("uncorrected_sentences"), rounded(ratio(c * 2, n * 2) * 100).alias("corrected_sentences_pct"),
    )


def corrected_only(pairs: DataFrame) -> DataFrame:
    """The same for corrected pairs alone; without any there is no row."""
    kept = pairs.where("corrected")
    counts = _with_total(kept, "corpus", [F.count(F.lit(1)).alias("corrected_pairs")], ALL_CORRECTED).where("corrected_pairs > 0")
    joined = counts.join(token_stats(kept, ["src", "tgt"], ALL_CORRECTED), "corpus", "left")
    words = F.coalesce("words", F.lit(0))
    return joined.select("corpus", "corrected_pairs", words.alias("words"), F.coalesce("unique_tokens", F.lit(0)).alias("unique_tokens"), rounded(ratio(words, F.col("corrected_pairs") * 2)).alias("avg_words_per_sentence"))


def count_share(df: DataFrame, key: str, total: str) -> DataFrame:
    """(key, sentence_count, percentage, percentage_value): rows per key; the total row says 100.00%."""
    counts = _with_total(df, key, [F.count(F.lit(1)).alias("sentence_count")], total)
    whole = F.max(F.when(F.col(key) == total, F.col("sentence_count"))).over(W.partitionBy())  # one row per key
    value = ratio("sentence_count", whole) * 100
    text = F.when(F.col(key) == total, F.lit("100.00%")).otherwise(F.concat(rounded(value).cast("string"), F.lit("%")))
    return counts.select(key, "sentence_count", text.alias("percentage"), rounded(value).alias("percentage_value"))


def correction_breakdown(pairs: DataFrame) -> DataFrame:
    """Per corpus: pairs with a known `corrected`, how many are corrected, how many not, and the corrected share of all its pairs."""
    c = F.col("corrected")
    counts = pairs.where("corpus is not null").groupBy("corpus").agg(F.count(F.lit(1)).alias("_n"), F.count(c).alias("total_pairs"), F.count_if(c).alias("corrected_pairs"), F.count_if(~c).alias("left_as_is"))
    return counts.withColumn("corrected_pct", percent_text("corrected_pairs", "_n")).drop("_n")


def correction_summary(pairs: DataFrame) -> DataFrame:
    """Three rows in long form: all pairs, corrected ones, ones left as they are; a null `corrected` counts as left."""
    one = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("corrected", F.lit(False))).alias("c"))
    n, c = F.col("n"), F.col("c")
    text = lambda x: F.format_string("%.2f%%", rounded(ratio(x, n) * 100))
    rows = [("Total Sentence Pairs", n, F.lit("100.00%")), ("Corrected Pairs (True)", c, text(c)), ("Left-As-Is Pairs (False)", n - c, text(n - c))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), x.alias("pair_count"), t.alias("percentage")) for name, x, t in rows])))


def documents_by_text_type(pairs: DataFrame) -> DataFrame:
    """(text_type, document_count, total_sentences, avg_sentences_per_doc, percentage) with TOTAL; a document is a file name with its type."""
    known = pairs.where("xml_file is not null and text_type is not null")
    each = known.groupBy("xml_file", "text_type").agg(F.count(F.lit(1)).alias("n"))
    counts = _with_total(each, "text_type", [F.count(F.lit(1)).alias("document_count"), F.sum("n").alias("total_sentences")], TOTAL)
    whole = F.max(F.when(F.col("text_type") == TOTAL, F.col("document_count"))).over(W.partitionBy())
    text = F.when(F.col("text_type") == TOTAL, F.lit("100.00%")).otherwise(percent_text("document_count", whole))
    return counts.select("text_type", "document_count", "total_sentences", rounded(ratio("total_sentences", "document_count")).alias("avg_sentences_per_doc"), text.alias("percentage"))


def corpus_by_text_type(pairs: DataFrame) -> DataFrame:
    """(corpus, text_type, sentence_count, percentage of all the corpus's pairs), and the rows of the whole corpus per type."""
    counts = pairs.groupingSets([["corpus", "text_type"], ["text_type"]], "corpus", "text_type").agg(F.grouping("corpus").alias("_all"), F.count(F.lit(1)).alias("sentence_count"))
    kept = counts.where("corpus is not null or _all = 1").withColumn("corpus", F.when(F.col("_all") == 1, F.lit(WHOLE)).otherwise(F.col("corpus")))
    whole = F.sum("sentence_count").over(W.partitionBy("corpus"))  # a few rows: one per type
    return kept.select("corpus", "text_type", "sentence_count", percent_text("sentence_count", whole).alias("percentage")).where("text_type is not null")


def text_lengths(texts: DataFrame) -> DataFrame:
    """(text_length, n): how many texts have each length in characters; null texts have none."""
    return texts.groupBy(F.length("text").alias("text_length")).agg(F.count(F.lit(1)).alias("n"))


def with_total_of(counts: DataFrame, key: str, count: str, total: str) -> DataFrame:
    """Each group's total beside its counts; `counts` has a few rows per key, so the window is over counts, not rows."""
    return counts.withColumn(total, F.sum(count).over(W.partitionBy(key)))


def total_last(table: DataFrame, total: str, *keys: str) -> DataFrame:
    """Sorted by its keys, the rows of the total at the end."""
    return table.orderBy(F.col(keys[0]) == total, *keys)


def profile_counts(pairs: DataFrame) -> DataFrame:
    return pairs.where("corpus is not null and lang_prof is not null").groupBy("corpus", "lang_prof").agg(F.count(F.lit(1)).alias("pair_count"))


def text_stats(texts: DataFrame, key: str, text: str, sentences: Column) -> DataFrame:
    """Of each single text: sentences, words, different tokens, words per sentence. Blank and null texts give zeros."""
    tokens = alpha_tokens(text)
    n = F.size(sentences)
    return texts.select(key, n.cast("long").alias("n_sentences"), F.size(tokens).cast("long").alias("words"), F.size(F.array_distinct(tokens)).cast("long").alias("unique_tokens"), rounded(ratio(F.size(tokens), n)).alias("avg_words_per_sentence"))
