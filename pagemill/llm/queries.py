"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bagminhash, chat, katz, packing, pieces, pii, quality, substring_dedup, topk, toxicity
from .common import load


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the files are installed, not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tool_call_linking(spark, sf_dir):
    calls, results = chat.extract(chat.told_as_calls(load(spark, sf_dir, "conversations")))
    return chat.link(calls, results, chat.SCHEMAS)


def op2_pii_deobfuscation(spark, sf_dir):
    return pii.digest(pii.find(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quality_rules(spark, sf_dir):
    return quality.digest(quality.judge(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.fit(docs, load(spark, sf_dir, "labels")).score(docs))


def op6_bagminhash(spark, sf_dir):
    return bagminhash.classes(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op7_best_fit_packing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


def op8_sampled_pieces(spark, sf_dir):
    return pieces.checked(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op9_katz_lm(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = katz.held_out(docs)
    scored = katz.score(docs.withColumn("train", ~held))
    return scored.withColumn("held_out", ~scored["train"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_exact_topk(spark, sf_dir):
    return topk.top_k(load(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_tool_call_linking, op2_pii_deobfuscation, op3_quality_rules, op4_substring_dedup, op5_toxicity, op6_bagminhash, op7_best_fit_packing, op8_sampled_pieces, op9_katz_lm, op10_exact_topk)}

ORACLE_SQL: dict[str, str] = {"op1_tool_call_linking": chat.SQL, "op3_quality_rules": quality.SQL, "op10_exact_topk": topk.SQL}
