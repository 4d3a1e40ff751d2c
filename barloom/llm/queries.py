"""The queries of the training-data operators, with their SQL where SQL can express them."""

from functools import wraps

import corpus_pipeline
from barloom.plans.shipping import ship

from . import alignment, embed_dedup, fingerprint, impact_index, katz, mixing, packing, relative_lz, simhash, templates, token_count, toxicity, url_rules


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_mixing": mixing.op2,
    "op3_katz": katz.op3,
    "op4_fingerprint": fingerprint.op4,
    "op5_simhash": simhash.op5,
    "op6_embed_dedup": embed_dedup.op6,
    "op7_templates": templates.op7,
    "op8_relative_lz": relative_lz.op8,
    "op9_packing": packing.op9,
    "op10_token_count": token_count.op10,
    "op11_impact_index": impact_index.op11,
    "op12_alignment": alignment.op12,
    "op13_url_rules": url_rules.op13,
    "pipeline": corpus_pipeline.run,
}

QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op6_embed_dedup": embed_dedup.ORACLE,
    "op7_templates": templates.ORACLE,
    "op8_relative_lz": relative_lz.ORACLE,
    "op11_impact_index": impact_index.ORACLE,
    "op13_url_rules": url_rules.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
