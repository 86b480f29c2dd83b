"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from . import importance, langid, lines, lm, media, merkle, minhash, mixing, packing, shards, substrings, toxicity, vectors

QUERIES = {
    "op1_packing": packing.op1,
    "op2_minhash": minhash.op2,
    "op3_media": media.op3,
    "op4_sharding": shards.op4,
    "op5_scoring": lm.op5,
    "op6_toxicity": toxicity.op6,
    "op7_mixing": mixing.op7,
    "op8_lines": lines.op8,
    "op9_substrings": substrings.op9,
    "op10_vectors": vectors.op10,
    "op11_langid": langid.op11,
    "op12_merkle": merkle.op12,
    "op13_importance": importance.op13,
}

SQL = {"op4_sharding": shards.OP4_SQL, "op7_mixing": mixing.OP7_SQL, "op12_merkle": merkle.OP12_SQL, "op13_importance": importance.OP13_SQL}
