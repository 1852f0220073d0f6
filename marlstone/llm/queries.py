"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, covertree, exact, licenses, minhash, mixing, pii, secrets, suffix, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_secrets": secrets.op2_secrets,
    "op3_bpe": bpe.op3_bpe,
    "op4_minhash_dedup": minhash.op4_minhash_dedup,
    "op5_embedding_dedup": covertree.op5_embedding_dedup,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
}
SQL = {"op4_minhash_dedup": minhash.OP4_SQL, "op5_embedding_dedup": covertree.OP5_SQL, "op6_exact_dedup": exact.OP6_SQL, "op8_suffix_dedup": suffix.OP8_SQL, "op9_mixing": mixing.OP9_SQL}
