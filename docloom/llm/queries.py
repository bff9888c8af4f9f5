"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import additive_quant, html_extract, importance, language_id, media, mixing, order_minhash, piece_fst, quality, suffix_dedup, toxicity, vector_codes, warc
from docloom.session import table


def op1_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark, sf_dir):
    index, folder = warc.archive(spark, table(spark, sf_dir, "pages"))
    records = warc.read_records(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_order_minhash(spark, sf_dir):
    return order_minhash.classes(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op4_sentencepiece(spark, sf_dir):
    return piece_fst.digest(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_additive_quant(spark, sf_dir):
    return additive_quant.neighbours(spark, table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark, sf_dir):
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_media_copies(spark, sf_dir):
    """The tables hold no images: one is drawn for every row of embeddings, crops and edits among them."""
    return media.classes(spark, media.render(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op11_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    docs, target = (table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    return importance.rank(spark, docs, target, keep=["doc_id"])


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_html_extract": op1_html_extract, "op2_warc": op2_warc, "op3_order_minhash": op3_order_minhash, "op4_sentencepiece": op4_sentencepiece, "op5_quality": op5_quality, "op6_additive_quant": op6_additive_quant, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_suffix_dedup": op9_suffix_dedup, "op10_media_copies": op10_media_copies, "op11_language_id": op11_language_id, "op12_importance": op12_importance, "op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {"op2_warc": warc.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op12_importance": importance.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
