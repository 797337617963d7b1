"""All queries of the subpackage: importing this module registers them."""

from cohera.llm import decontamination, exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, repeated_bytes, token_counts, toxicity, turn_repair, vector_codes, warc_store  # noqa: F401
from cohera.llm.registry import QUERIES, SQL  # noqa: F401
