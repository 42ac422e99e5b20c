"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe
from .alignment import align
from .common import table
from .decontaminate import hit_report
from .langid import predict_languages
from .merkle import verify_documents
from .minhash import near_duplicates
from .oracle import ORACLE
from .pii import span_report
from .quality_model import score_documents
from .quality_rules import quality_report
from .sharding import shard_report
from .token_store import token_digests
from .toxicity import score_documents as score_toxicity

from .url_filter import judge_pages


def tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark, sf_dir):
    """Token ids of all documents, written as patched frame-of-reference files and read back."""
    return token_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op5_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


def op6_sharding(spark, sf_dir):
    """Shard of every document by extendible hashing, at most 8 MiB of text a shard."""
    return shard_report(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    """Byte-level BPE ids of all documents and the texts decoded from them."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ["doc_id"])


def op8_language_id(spark, sf_dir):
    """Predicted language of every document, learnt from the rows that aren't held out."""
    return predict_languages(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    """Rule measures and verdict of every document."""
    return quality_report(table(spark, sf_dir, "documents"))


def op1_quality_model(spark, sf_dir):
    """Quality score of every document, learnt from the labels that aren't held out."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir):
    """Personal data spans of every document: base patterns and the CRF's."""
    return span_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Hit words and matched benchmark items of every document."""
    return hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    """Rule and verdict of every page url, block decisions shared among aliases."""
    return judge_pages(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark, sf_dir):
    """Leaf, roots and checked proof of every document; half of them are folded with an altered text."""
    return verify_documents(table(spark, sf_dir, "documents"))


def op12_toxicity(spark, sf_dir):
    """Toxicity score of every document from its nearest labelled examples that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers in every document."""
    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}
ORACLE = {k: v for k, v in ORACLE.items() if k in QUERIES}
