"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from assayloom.llm.conversation_trie import op11_conversation_trie
from assayloom.llm.conversation_trie import oracle as op11_oracle
from assayloom.llm.dataset_manifest import op12_dataset_manifest
from assayloom.llm.dataset_manifest import oracle as op12_oracle
from assayloom.llm.embedding_dedup import op4_embedding_dedup
from assayloom.llm.license_scans import op8_license_scans
from assayloom.llm.license_scans import oracle as op8_oracle
from assayloom.llm.mixing import op6_mixing
from assayloom.llm.packing import op7_packing
from assayloom.llm.quality_rules import op9_quality_rules
from assayloom.llm.rule_ensemble import op13_quality_classifier
from assayloom.llm.secret_scans import op10_secret_scans
from assayloom.llm.simhash_dedup import op2_simhash_dedup
from assayloom.llm.token_counts import op1_token_counts
from assayloom.llm.url_filters import op5_url_filters
from assayloom.llm.url_filters import oracle as op5_oracle
from assayloom.llm.warc_fixity import op3_warc_fixity
from assayloom.llm.warc_fixity import oracle as op3_oracle

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_license_scans": op8_license_scans,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_dataset_manifest": op12_dataset_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_fixity": op3_oracle(),
    "op5_url_filters": op5_oracle(),
    "op8_license_scans": op8_oracle(),
    "op11_conversation_trie": op11_oracle(),
    "op12_dataset_manifest": op12_oracle(),
}
