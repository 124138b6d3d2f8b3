"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.canonical import aliases_of, map_values
from graphloom.llm.cooccurrence import cooccurrence, least_llr
from graphloom.llm.encoding import round_trip, token_counts, token_ids
from graphloom.llm.frequency import document_count, marked, term_frequencies
from graphloom.llm.mixture import Mixture
from graphloom.llm.near_duplicates import NearDuplicates
from graphloom.llm.one_form import consistent
from graphloom.llm.spam import spam, spam_scores
from graphloom.llm.split import split_texts
from graphloom.llm.sql import SQL  # noqa: F401
from graphloom.util import cut, read, small

TYPE_LIMIT = 10_000  # rows of an ontology table up to which it is broadcast


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity's mention_text and evidence in the consistent form. Copies count once."""
    rows = consistent(read(spark, sf_dir, "entities").select("entity_id", "mention_text", "evidence"), ["mention_text", "evidence"])
    return rows.select("entity_id", F.col("mention_text_form").alias("mention_text"), F.col("evidence_form").alias("evidence")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ from their consistent form."""
    rows = consistent(read(spark, sf_dir, "entities").select("entity_id", "mention_text", "evidence"), ["mention_text", "evidence"])
    cases = [F.when(F.col(f) != F.col(f"{f}_form"), F.lit(f)) for f in ("mention_text", "evidence")]
    return rows.select("entity_id", F.explode(F.array_compact(F.array(*cases))).alias("field_name")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every source_text: at most 4,000 characters, up to 200 of overlap. Copies of a request count once; another text of the same request is cut too, under its own text_no."""
    rows = read(spark, sf_dir, "extraction_requests").select("doc_id", "source_text").distinct().where("source_text is not null")
    keyed = rows.select(F.struct("doc_id", F.xxhash64("source_text").alias("text_no")).alias("k"), "source_text")
    return split_texts(keyed, "k", "source_text", 4000, 200).select("k.*", "piece_no", "n_pieces", "begin", "end", "piece")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose text came out in more than one piece."""
    rows = read(spark, sf_dir, "extraction_requests").select("doc_id", "source_text")
    return split_texts(rows, "doc_id", "source_text", 4000, 200).where("n_pieces > 1").select("doc_id").distinct()


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its pieces: its hash, the fewest pieces that it can have, and whether all pieces keep limit, overlap and order."""
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "begin", "end", "piece")))
    rows = p3_pieces(spark, sf_dir).withColumn("own", F.sha2("piece", 256)).groupBy("doc_id", "text_no", "n_pieces").agg(parts.alias("p"))
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.get("p", i - 1)["end"] - x["begin"] + 1, F.lit(1 << 30))))
    good = F.forall(F.sequence(F.lit(0), F.col("n_pieces") - 1), lambda i: (F.length(F.get("p", i)["piece"]) <= 4000) & ((i == 0) | (F.get("p", i - 1)["end"] - F.get("p", i)["begin"]).between(0, 200)))
    size = F.length(F.array_join(fresh, ""))
    fewest = F.when(size <= 4000, 1).otherwise(1 + F.ceil((size - 4000) / 3800)).cast("int")
    return rows.select("doc_id", F.sha2(F.array_join(fresh, ""), 256).alias("source_sha256"), fewest.alias("fewest"), (good & (F.size("p") == F.col("n_pieces"))).alias("good")).distinct()


def _related(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(read(spark, sf_dir, "extraction_requests"), "doc_id", "source_text", k=3, percent=70, min_words=20)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of requests with at least 70 % of their runs of three words in common."""
    return _related(spark, sf_dir).row_pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request of 20 words or more with its class of equal texts, its group and its number of links."""
    return _related(spark, sf_dir).groups()


def _type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "ontology_entity_types").select("id").union(read(spark, sf_dir, "ontology_relation_types").select("id")).distinct()
    rows = [read(spark, sf_dir, t).select("doc_id", F.col("ontology_type").alias("id")) for t in ("cast_entities", "cast_relations")]
    items = rows[0].union(rows[1]).join(small(known, TYPE_LIMIT), "id", "left_semi")
    pairs = cooccurrence(items, "doc_id", "id")
    return pairs.withColumnsRenamed({"item_a": "type_a", "item_b": "type_b"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ontology types together in at least 3 documents, 1 % of them, and half as often again as by chance.

    The significance asked of a pair is the one that this definition implies (least_llr), so the test drops no case; the counts decide exactly.
    """
    tested = _type_pairs(spark, sf_dir).where(F.col("llr") >= least_llr(F.col("n_ab"), 1.5))
    return tested.where("n_ab >= 3 and 100 * n_ab >= n_docs and 2 * n_ab * n_docs >= 3 * n_a * n_b").select("type_a", "type_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of ontology types with its counts, lift and log-likelihood ratio (rounded to 6 places)."""
    return _type_pairs(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("lift", "llr")})


FREE_TYPES = {"entities": ("entity_id", "free_type"), "relations": ("relation_id", "free_type"), "cast_entities": ("entity_id", "ontology_type")}


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a value that is no id of its list, with the id of the entry meant."""
    kinds = read(spark, sf_dir, "ontology_entity_types")
    ties = read(spark, sf_dir, "ontology_relation_types")
    lists = {"entities": aliases_of(kinds, "id", ["label"], ["synonyms"]), "relations": aliases_of(ties, "id", ["label"])}
    lists["cast_entities"] = lists["entities"]
    out = None
    for table, (record, value) in FREE_TYPES.items():
        known = F.broadcast(spark.createDataFrame([(e,) for e in sorted({e for e, _ in lists[table]})], "value string"))  # bounded by aliases_of
        rows = read(spark, sf_dir, table).select(F.lit(table).alias("table_name"), F.col(record).alias("record_id"), F.col(value).alias("value"))
        # copies are equal in everything, so they meet before the values are mapped
        rows = rows.where(F.col("record_id").isNotNull() & ~F.col("value").rlike(r"^[\s\h\x{85}\x{2028}\x{2029}]*$") & F.col("value").isNotNull()).join(known, "value", "left_anti").select("table_name", "record_id", "value").distinct()
        part = map_values(rows, "value", lists[table])
        out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose type is freely written, with the id of the entry meant or ''."""
    return _mapped(spark, sf_dir).select("table_name", "record_id", "type_id").distinct()


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every freely written value with the id of the entry meant, '' where it means none, its score and runner-up, and its number of records.

    tie: two entries score alike, and the least id was taken.
    """
    keys = ["table_name", "value", "type_id", "score", "runner_up", "next_score"]
    rows = _mapped(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
    return rows.withColumn("tie", F.expr("type_id <> '' and runner_up <> '' and score = next_score"))


FIELDS = {"entities": ("entity_id", ["free_type", "mention_text"]), "relations": ("relation_id", ["free_type"])}


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three fields with its record and document counts and mark ('common', 'rare' or '')."""
    out = None
    for table, (record, fields) in FIELDS.items():
        rows = read(spark, sf_dir, table)
        counts = marked(term_frequencies(rows, fields, record), document_count(rows))
        part = counts.select(F.concat(F.lit(f"{table}."), "field").alias("field_name"), F.col("term").alias("field_value"), "n_records", "n_docs", "mark")
        out = part if out is None else out.unionByName(part)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in at least a tenth of the documents ('common') or in one document ('rare')."""
    return p7_terms(spark, sf_dir).where("mark <> ''").select("field_name", "field_value", "mark")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return token_ids(read(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding the ids of a document gives its text back."""
    return round_trip(read(spark, sf_dir, "documents")).select("doc_id", "same")


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    sizes = cut(token_counts(read(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return Mixture(sizes, read(spark, sf_dir, "mixture_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a listed source with its tokens and how often the mixture uses it."""
    return _mixture(spark, sf_dir).rows


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of tokens of every listed source."""
    return _mixture(spark, sf_dir).report()


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed source with its documents, and whether the mixture keeps its repeats and comes within one document of the tokens it is to supply."""
    m = _mixture(spark, sf_dir)
    goals = m.plan.select("source", (F.col("tokens") * (F.col("whole") + F.col("fraction"))).alias("goal"))
    largest = m.rows.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    met = m.report().join(goals, "source").join(largest, "source", "left")
    kept = (F.abs(F.col("tokens_used") - F.col("goal")) <= F.coalesce("largest", F.lit(0)) + 1) & (F.col("most_copies") <= F.col("max_repeats"))
    return met.select("source", "target_share", "max_repeats", "n_docs", kept.alias("kept"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are keyword, link, navigation or tag lists inside cues."""
    return spam(read(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, robust distance and position towards spam of every document with words."""
    return spam_scores(read(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_forms": p1_forms,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_whole": p3_whole, "p4_found": p4_found, "p4_groups": p4_groups,
    "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p6_found": p6_found, "p6_values": p6_values, "p7_found": p7_found, "p7_terms": p7_terms, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_report": p9_report, "p9_checks": p9_checks,
    "p10_found": p10_found, "p10_scores": p10_scores,
}
