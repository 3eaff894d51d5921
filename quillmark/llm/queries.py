"""Driver queries of the training-data operators."""

from __future__ import annotations

from .avi import media_features
from .common import table
from .erasure import erase
from .langid import identify_languages
from .linededup import line_dedup_digest
from .merkle import manifest
from .mixing import mix
from .oracles import ORACLES
from .pieces import segment_documents
from .quality import quality_scores
from .repetition import repetition_rules
from .setjoin import jaccard_components
from .sharding import shard_documents
from .simhash import simhash_components
from .toxicity import toxicity_scores


def op1_suffix_repetition(spark, sf_dir):
    return repetition_rules(table(spark, sf_dir, "documents"))


def op2_additive_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_avi_mjpeg(spark, sf_dir):
    return media_features(table(spark, sf_dir, "documents"))


def op4_temperature_mixture(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op5_minhash_lines(spark, sf_dir):
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op6_marginal_unigram_language(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_noisy_channel_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minimax_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_nbest_pieces(spark, sf_dir):
    return segment_documents(table(spark, sf_dir, "documents"))


def op10_simhash_components(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_cascading_erasure(spark, sf_dir):
    return erase(spark, *[table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")])


def op12_partenum_components(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_repetition,
        op2_additive_quality,
        op3_avi_mjpeg,
        op4_temperature_mixture,
        op5_minhash_lines,
        op6_marginal_unigram_language,
        op7_noisy_channel_toxicity,
        op8_minimax_shards,
        op9_nbest_pieces,
        op10_simhash_components,
        op11_cascading_erasure,
        op12_partenum_components,
        op13_merkle_manifest,
    )
}

__all__ = ["ORACLES", "QUERIES"]
