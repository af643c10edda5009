"""The registered queries over these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common as c
from .decontaminate import contamination_report
from .filter_audit import audit_filters
from .line_dedup import dedup_lines
from .merkle import audit_manifest
from .near_dedup import near_components
from .packing import pack
from .pii import scan_pii
from .quality import quality_report
from .secret_scan import scan_secrets
from .sharding import shard_documents
from .sql import ORACLES
from .substring_dedup import dedup_substrings
from .token_count import count_documents
from .url_filter import filter_urls


def op1_substring_dedup(spark, sf_dir):
    return dedup_substrings(c.table(spark, sf_dir, "documents")).drop("kept_text")


def op2_url_filters(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(pages)
    return out.select("row.page_id", "host", "path", "rule", "verdict", "template")


def op3_quality_rules(spark, sf_dir):
    return quality_report(c.table(spark, sf_dir, "documents")).drop("failed_rule")


def op4_minhash_near_dedup(spark, sf_dir):
    return near_components(c.table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    out = dedup_lines(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_benchmark_decontamination(spark, sf_dir):
    out = contamination_report(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return out.drop("items")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark, sf_dir):
    return pack(c.table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_scans(spark, sf_dir):
    return scan_secrets(c.table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return count_documents(c.table(spark, sf_dir, "documents"), tokenizer_path(), eod=49407)


def op10_pii(spark, sf_dir):
    return scan_pii(c.table(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    return shard_documents(c.table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return audit_manifest(c.table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark, sf_dir):
    return audit_filters(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in queries() if name in ORACLES}
