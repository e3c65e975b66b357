"""The core queries: each is (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paarwerk.functions.tables import corpus_key
from paarwerk.operators import align, clean, extract, linearize, nested, segment, stats
from paarwerk.plans import goldens
from paarwerk.session import new_path, spread, strip, table
from paarwerk.sources import files, sinks
from paarwerk.streaming import ingest


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_corpora")


def _spread_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_pairs(spark, d), "pair_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """raw_files with the dialect of its corpus: attributes in one corpus, child elements in the others."""
    return spread(table(spark, d, "raw_files"), "file_id").withColumn("dialect", F.when(F.col("corpus") == "LEONIDE", "P").otherwise("X"))


def corpus_overview(spark, d):
    return stats.corpus_overview(_spread_pairs(spark, d))


def corrected_only(spark, d):
    return stats.corrected_only(_spread_pairs(spark, d))


def sentence_count_pct(spark, d):
    return stats.count_share(_pairs(spark, d), "corpus", stats.WHOLE)


def correction_breakdown(spark, d):
    return stats.correction_breakdown(_pairs(spark, d))


def correction_summary_long(spark, d):
    return stats.correction_summary(_pairs(spark, d))


def text_type_sentence(spark, d):
    return stats.count_share(_pairs(spark, d), "text_type", stats.TOTAL)


def text_type_document(spark, d):
    return stats.documents_by_text_type(_pairs(spark, d))


def corpus_by_text_type(spark, d):
    return stats.corpus_by_text_type(_pairs(spark, d))


def lang_profile_count(spark, d):
    return stats.profile_counts(_pairs(spark, d))


def language_tokens(spark, d):
    """Words and vocabulary of the whole texts per language, and of all."""
    return stats.token_stats(_documents(spark, d), ["text"], stats.WHOLE, key="lang")


def single_text_stats(spark, d):
    cut = F.filter(F.split(strip(F.coalesce("text", F.lit(""))), segment.CUT), lambda x: x != "")
    return stats.text_stats(_documents(spark, d), "doc_id", "text", cut)


def alpha_tokens(spark, d):
    return _documents(spark, d).select("doc_id", F.posexplode(stats.alpha_tokens("text")).alias("pos", "token"))


def whitespace_tokens(spark, d):
    return _pairs(spark, d).select("pair_id", F.size(align.tokens(F.coalesce("src", F.lit("")))).alias("src_tokens"), F.size(align.tokens(F.coalesce("tgt", F.lit("")))).alias("tgt_tokens"))


def text_type_case(spark, d):
    rows = _pairs(spark, d)
    return rows.select("pair_id", extract.text_type("corpus", "xml_file").alias("derived_type"))


def sorted_corpora(spark, d):
    return _pairs(spark, d).where("corpus is not null").select("corpus").distinct().orderBy("corpus")


def bag_union(spark, d):
    """All sentences of both sides as one bag: how often each length comes."""
    return stats.text_lengths(align.bag(_pairs(spark, d), ["src", "tgt"]))


def clean_filters(spark, d):
    return clean.filtered(_spread_pairs(spark, d).select("pair_id", "src", "tgt"))


def interjection_strip(spark, d):
    return _documents(spark, d).select("doc_id", clean.without_interjections("text").alias("text"))


def list_marker_strip(spark, d):
    return _documents(spark, d).select("doc_id", clean.without_list_mark("text").alias("text"))


def whitespace_normal(spark, d):
    facts = linearize.line_facts(_documents(spark, d), "doc_id", "text")
    return _documents(spark, d).select("doc_id", align.one_line(F.col("text")).alias("text")).join(facts.select("doc_id", "leads", "trails"), "doc_id")


def punctuation_spacing(spark, d):
    """Blanks collapsed, none before punctuation; and whether the text ends a sentence."""
    return linearize.line_facts(_documents(spark, d), "doc_id", "text").select("doc_id", "text", "ends_sentence")


def word_count_filter(spark, d):
    return _pairs(spark, d).select("pair_id", F.least(clean.word_count("src"), clean.word_count("tgt")).alias("n_words")).where(F.col("n_words") >= clean.LEAST_WORDS)


def remark_filter(spark, d):
    return _documents(spark, d).where(clean.is_remark("text")).select("doc_id")


def _by_document(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows with their document: the file name in its corpus, whose spelling doesn't count; a row without a file is one by itself."""
    alone = F.when(F.col("xml_file").isNull(), F.col("pair_id"))
    return _pairs(spark, d).select(corpus_key("corpus").alias("in_corpus"), "xml_file", alone.alias("alone"), "pair_id", *columns)


DOCUMENT = ["in_corpus", "xml_file", "alone"]


def dedup_first(spark, d):
    return clean.first_of_each(_by_document(spark, d, "src", "tgt"), DOCUMENT, ["pair_id"]).select("pair_id")


def renumber(spark, d):
    return clean.numbered(_by_document(spark, d), DOCUMENT, "pair_id", "new_num").select("xml_file", "pair_id", "new_num")


def limit_per_corpus(spark, d):
    return files.first_files(_raw(spark, d).select("corpus", "path").distinct(), 5)


def exclude_anti(spark, d):
    """Rows whose file isn't among the files of one school class."""
    return files.excluded(_pairs(spark, d), table(spark, d, "text_meta").where("school_class_id = 'A'")).select("pair_id", "xml_file")


def share_join(spark, d):
    """Group counts joined with their totals, as a window over the counts."""
    counts = _pairs(spark, d).where("corpus is not null and text_type is not null").groupBy("corpus", "text_type").agg(F.count(F.lit(1)).alias("n"))
    return stats.with_total_of(counts, "corpus", "n", "corpus_total")


def sentence_split(spark, d):
    return _documents(spark, d).select("doc_id", F.posexplode(segment.sentences("text")).alias("pos", "sentence"))


def fragment_merge(spark, d):
    """Fragments between blanks behind punctuation, joined where one goes on in lower case."""
    rows = spread(table(spark, d, "sentencepair"), "chunk_id")
    pieces = F.filter(F.transform(F.split(F.coalesce("tgt", F.lit("")), segment.CUT), strip), lambda x: x != "")
    return rows.select("chunk_id", F.posexplode(segment.merged(pieces)).alias("pos", "sentence"))


def zip_longest_sentences(spark, d):
    rows = spread(table(spark, d, "sentencepair"), "chunk_id")
    return rows.select("chunk_id", F.posexplode(align.zip_longest(segment.sentences("src"), segment.sentences("tgt"))).alias("pos", "p")).select("chunk_id", "pos", "p.src", "p.tgt")


def zip_longest_tokens(spark, d):
    rows = _spread_pairs(spark, d)
    return rows.select("pair_id", F.posexplode(align.token_pairs(F.col("src"), F.col("tgt"))).alias("pos", "p")).select("pair_id", "pos", F.col("p.src").alias("src_token"), F.col("p.tgt").alias("tgt_token"))


def norm_lines(spark, d):
    return _spread_pairs(spark, d).select("pair_id", align.norm_block(F.col("src"), F.col("tgt")).alias("block"))


def sentbreak_chunks(spark, d):
    """Texts cut at their blank lines, as chunks between sentence breaks."""
    marked = F.replace("text", F.lit("\n\n"), F.lit(linearize.BREAK))
    return _documents(spark, d).select("doc_id", align.breaks(marked).alias("n_breaks"), F.posexplode(align.chunks(marked)).alias("pos", "chunk"))


def hash_split(spark, d):
    """A split per file by a hash of its name: 80 / 10 / 10."""
    return extract.hash_split(_pairs(spark, d))


def _exported(spark: SparkSession, d: str) -> tuple[str, list[dict]]:
    """raw_files written as files, `corpus/file_id/name`, and a registry of their folders."""
    folder = new_path(spark, "export")
    raw = _raw(spark, d).where("content is not null")
    sinks.write_files(raw.select(F.concat_ws("/", "corpus", "file_id", F.element_at(F.split("path", "/"), -1)).alias("path"), "content"), folder)
    names = table(spark, d, "corpora").collect()  # the registry: a fixed table of a few rows
    return folder, [{"corpus": r.corpus, "base_dir": f"{folder}/{r.corpus}", "lang_prof": r.lang_prof, "dialect": "P" if r.corpus == "LEONIDE" else "X"} for r in names]


def scan_files(spark, d):
    """The files of the registry's folders, found again on disk."""
    _, registry = _exported(spark, d)
    return files.scan_corpora(spark, registry).select("corpus", "lang_prof", "dialect", "xml_file", F.length("content").cast("long").alias("n_bytes"))


def stream_files(spark, d):
    """One corpus's folder read as a stream: pairs per file, each file once."""
    _, registry = _exported(spark, d)
    entry = next(r for r in registry if r["dialect"] == "P")
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    ingest.ingest(ingest.drop_folder(spark, entry["base_dir"], entry["corpus"], entry["lang_prof"], entry["dialect"]), out, state).awaitTermination()
    return spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.PAIRS)).parquet(out).groupBy("xml_file").agg(F.count(F.lit(1)).alias("n_pairs"))


def read_sidecars(spark, d):
    """text_meta written as `key=value` files and read back."""
    folder = new_path(spark, "sidecars")
    fields = ["corpus", "xml_file", "author_id", "task_type", "author_l1", "task_year"]
    lines = F.array_join(F.filter(F.array(*[F.concat(F.lit(f" {c} = "), F.col(c).cast("string")) for c in fields]), lambda x: x.isNotNull()), "\n")
    sinks.write_files(table(spark, d, "text_meta").select(F.concat(F.col("meta_id").cast("string"), F.lit(".meta")).alias("path"), F.encode(lines, "UTF-8").alias("content")), folder)
    found = files.read_sidecars(spark, folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.meta$", 1).cast("long").alias("meta_id"), *[F.col("meta")[c].alias(c) for c in fields])


def read_texts(spark, d):
    """eval_items written as one text file each and read back whole."""
    folder = new_path(spark, "texts")
    rows = table(spark, d, "eval_items").where("text is not null")
    sinks.write_files(rows.select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")), folder)
    return files.read_texts(spark, folder).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("item_id"), "text")


def norm_sink(spark, d):
    """Verticalised pairs written per corpus and read back: lines of each kind."""
    path = new_path(spark, "norm")
    sinks.write_norm(_pairs(spark, d).where("corpus is not null"), path)
    lines = spark.read.schema("value string, corpus string").text(path)
    return lines.groupBy("corpus").agg(F.count_if(F.col("value") == "").alias("blank_lines"), F.count_if(F.col("value") != "").alias("token_lines"))


def missing_csv(spark, d):
    """A CSV that isn't there is an empty pair table."""
    return files.read_pairs_csv(spark, new_path(spark, "missing"))


def csv_round_trip(spark, d):
    """The pair table written as CSV and read back with its schema."""
    path = new_path(spark, "csv")
    sinks.write_pairs_csv(_pairs(spark, d), path)
    return files.read_pairs_csv(spark, path)


def linearize_p(spark, d):
    raw = _raw(spark, d).where("dialect = 'P'")
    return linearize.linearise(raw.select(F.col("file_id").cast("string").alias("doc"), "content", "dialect"))


def linearize_x(spark, d):
    raw = _raw(spark, d).where("dialect = 'X'")
    return linearize.linearise(raw.select(F.col("file_id").cast("string").alias("doc"), "content", "dialect"))


def _docs(spark, d):
    return _raw(spark, d).select(F.col("file_id").cast("string").alias("doc"), "content", "dialect")


def raw_sentence_pairs(spark, d):
    return extract.raw_pairs(_docs(spark, d))


def extract_pairs(spark, d):
    raw = _raw(spark, d)
    by_file = raw.withColumn("path", F.concat_ws("#", "path", "file_id"))
    return extract.pair_table(by_file.withColumn("xml_file", F.element_at(F.split(F.element_at(F.split("path", "#"), 1), "/"), -1)))


def extract_pairs_strict(spark, d):
    return extract.extract(_docs(spark, d), strict=True)


def extract_problems(spark, d):
    return extract.problems(_docs(spark, d))


def problem_files(spark, d):
    """The files that gave an error instead of pairs."""
    return extract.problems(_docs(spark, d)).select("doc")


def _golden_files(spark: SparkSession) -> DataFrame:
    rows = [(name, bytearray(xml.encode()), dialect) for name, (dialect, xml) in goldens.DOCUMENTS.items()]
    return spark.createDataFrame(rows, "doc string, content binary, dialect string")


def golden_sections(spark, d):
    return linearize.linearise(_golden_files(spark)).where("error is null").select("doc", "section", "src", "tgt")


def golden_raw_pairs(spark, d):
    return extract.raw_pairs(_golden_files(spark)).select("doc", "section", "pos", "src", "tgt", "corrected", "has_foreign")


def golden_pairs(spark, d):
    return extract.extract(_golden_files(spark))


def golden_pairs_strict(spark, d):
    return extract.extract(_golden_files(spark), strict=True)


def golden_problems(spark, d):
    return extract.problems(_golden_files(spark)).select("doc")


def p2_found(spark, d):
    return nested.field_rows(_raw(spark, d)).select("file_id", "ann_no", "parent_ann_no", "field", "field_seq")


def p2_fields(spark, d):
    return nested.field_rows(_raw(spark, d))


def p2_nodes(spark, d):
    return nested.occurrences(nested.read(_raw(spark, d))).withColumn("hash", F.hex("hash"))


def p2_objects(spark, d):
    things = nested.objects(nested.read(_raw(spark, d)))
    return things.select(F.hex("hash").alias("hash"), "name", F.to_json("attributes").alias("attributes"), "text", "blank", F.size("children").alias("n_children"))


def p2_bridge(spark, d):
    links = nested.bridge(nested.objects(nested.read(_raw(spark, d))))
    return links.select(F.hex("parent_hash").alias("parent_hash"), "ordinal", "name", "seq", F.hex("child_hash").alias("child_hash"))


QUERIES = {f.__name__: f for f in (
    corpus_overview, corrected_only, sentence_count_pct, correction_breakdown, correction_summary_long, text_type_sentence, text_type_document,
    corpus_by_text_type, lang_profile_count, language_tokens, single_text_stats, alpha_tokens, whitespace_tokens, text_type_case, sorted_corpora, bag_union,
    clean_filters, interjection_strip, list_marker_strip, whitespace_normal, punctuation_spacing, word_count_filter, remark_filter, dedup_first, renumber,
    limit_per_corpus, exclude_anti, share_join, sentence_split, fragment_merge, zip_longest_sentences, zip_longest_tokens, norm_lines, sentbreak_chunks,
    hash_split, csv_round_trip, scan_files, stream_files, read_sidecars, read_texts, norm_sink, missing_csv, linearize_p, linearize_x, raw_sentence_pairs, extract_pairs, extract_pairs_strict, extract_problems, problem_files,
    golden_sections, golden_raw_pairs, golden_pairs, golden_pairs_strict, golden_problems,
    p2_found, p2_fields, p2_nodes, p2_objects, p2_bridge,
)}
