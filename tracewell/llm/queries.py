"""The registered queries of this subpackage and their SQL."""

from . import bpe, chat, embed, langid, media, minhash, mixing, oracles, pii, sharding, suffixdedup

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_chat": chat.op4_chat,
    "op5_media": media.op5_media,
    "op6_repeats": suffixdedup.op6_repeats,
    "op7_mixing": mixing.op7_mixing,
    "op8_minhash": minhash.op8_minhash,
    "op9_sharding": sharding.op9_sharding,
    "op10_embeddings": embed.op10_embeddings,
}
ORACLES = {
    "op4_chat": oracles.CHAT,
    "op7_mixing": oracles.MIXING,
    "op8_minhash": oracles.NEAR,
    "op9_sharding": oracles.SHARDING,
    "op10_embeddings": oracles.VECTORS,
}
