"""Registered queries of the operators, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import balls, conversations, decontaminate, language, mixing, neighbours, sharding, simhash, substrings, tokens, toxicity, url_filter, warc
from tessera.llm.common import read_table

QUERIES = {
    "op1_token_ids": lambda spark, sf_dir: tokens.token_digest(read_table(spark, sf_dir, "documents")),
    "op2_decontaminate": lambda spark, sf_dir: decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
    "op3_toxicity": lambda spark, sf_dir: toxicity.toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op4_mix_sources": lambda spark, sf_dir: mixing.mixed_sizes(read_table(spark, sf_dir, "documents")),
    "op5_url_filter": lambda spark, sf_dir: url_filter.filter_urls(read_table(spark, sf_dir, "pages")),
    "op6_shards": lambda spark, sf_dir: sharding.shard_digest(read_table(spark, sf_dir, "documents")),
    "op7_language": lambda spark, sf_dir: language.language_digest(read_table(spark, sf_dir, "documents")),
    "op8_simhash": lambda spark, sf_dir: simhash.simhash_digest(read_table(spark, sf_dir, "documents")),
    "op9_neighbours": lambda spark, sf_dir: neighbours.nearest(read_table(spark, sf_dir, "embeddings")),
    "op10_warc": lambda spark, sf_dir: warc.round_trip(read_table(spark, sf_dir, "pages")),
    "op11_conversations": lambda spark, sf_dir: conversations.repair_digest(read_table(spark, sf_dir, "conversations")),
    "op12_ball_clusters": lambda spark, sf_dir: balls.clusters_digest(read_table(spark, sf_dir, "embeddings")),
    "op13_substrings": lambda spark, sf_dir: substrings.repeats_digest(read_table(spark, sf_dir, "documents")),
}

ORACLE_SQL = {"op4_mix_sources": mixing.ORACLE, "op11_conversations": conversations.ORACLE, "op12_ball_clusters": balls.ORACLE, "op13_substrings": substrings.ORACLE}
