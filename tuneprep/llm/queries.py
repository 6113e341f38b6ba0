"""One driver query for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm import collocations, langid, mixing, nndescent, sharding, toxicity, variants
from tuneprep.llm.decontaminate import find_leaks
from tuneprep.llm.licenses import scan_licenses
from tuneprep.llm.lmscore import load_vocabulary, score_texts
from tuneprep.llm.minhash import near_duplicates
from tuneprep.llm.mixing import mix_sources
from tuneprep.llm.pii import disclosing_terms, find_personal_data
from tuneprep.llm.sharding import shard_rows
from tuneprep.llm.vectors import near_vectors

#: A sentencepiece model whose pieces and scores the language model takes over.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that match a licence template."""
    return scan_licenses(_documents(spark, sf_dir), runs=True)


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold, by BM25 retrieval and verification."""
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on runs of three words at 85 %."""
    return near_duplicates(_documents(spark, sf_dir), size=3, percent=85)


def op4_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a network trained on a sample of them."""
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op6_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document, by clauses of a grammar whose insults labels teach."""
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The log-probability of each document over the lattices of its words."""
    return score_texts(_documents(spark, sf_dir), load_vocabulary(vocabulary))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, and the terms that reveal it."""
    docs = _documents(spark, sf_dir)
    return find_personal_data(docs, disclosing_terms(docs))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, by near equal bytes."""
    # The checksum is taken before rows move, so no text moves with them.
    docs = _documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shard_rows(docs, sharding.SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with the frequent word one edit away that each may misspell."""
    words = variants.count_words(_documents(spark, sf_dir), variants.MIN_LENGTH, variants.MIN_COUNT, variants.DROP_EVERY)
    return variants.group_variants(words, variants.TIMES)


def op12_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language whose words occur together more often than by chance."""
    return collocations.mine_phrases(_documents(spark, sf_dir), longest=5, min_count=100, top=2000)


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found for every hundredth vector, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nndescent.search(nndescent.build_graph(vectors, k=10), vectors.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_block_max_wand": op2_block_max_wand,
    "op3_minhash": op3_minhash,
    "op4_covertree": op4_covertree,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_pattern_grammar": op6_pattern_grammar,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_mixing": op8_mixing,
    "op9_disclosure": op9_disclosure,
    "op10_histogram_sort": op10_histogram_sort,
    "op11_trie_frontier": op11_trie_frontier,
    "op12_double_array": op12_double_array,
    "op13_nn_descent": op13_nn_descent,
}
#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op8_mixing": mixing.SQL,
    "op10_histogram_sort": sharding.SQL,
    "op11_trie_frontier": variants.SQL,
    "op12_double_array": collocations.SQL,
}
