"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> (module, function, name of its SQL or None).
_QUERIES = {
    "op1_best_fit_packing": ("packing", "op1", None),
    "op2_ppm_language": ("ppm_langid", "op2", None),
    "op3_toxicity_chain": ("toxicity_chain", "op3", None),
    "op4_host_quality": ("quality_hosts", "op4", "OP4_SQL"),
    "op5_rake_and_sample": ("mixing", "op5", None),
    "op6_feistel_shards": ("token_output", "op6", None),
    "op7_warc_derivatives": ("warc", "op7", "OP7_SQL"),
    "op8_jaccard_components": ("jaccard_join", "op8", None),
    "op9_token_counts": ("token_counts", "op9", None),
    "op10_cuckoo_dedup": ("exact_dedup", "op10", "OP10_SQL"),
    "op11_discriminant_quality": ("quality_qda", "op11", None),
    "op12_merkle_manifest": ("merkle_manifest", "op12", "OP12_SQL"),
    "op13_feast_whitening": ("whitening", "op13", None),
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {name: getattr(_module(module), function) for name, (module, function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(module), sql) for name, (module, _, sql) in _QUERIES.items() if sql}
