"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from lumenflow.llm import op4_minhash, op5_chat, op8_lines, op11_topk, op12_resampling, op13_trie
from lumenflow.llm.op1_language import op1_language
from lumenflow.llm.op2_urls import op2_urls
from lumenflow.llm.op3_wavelet import op3_wavelet
from lumenflow.llm.op6_fingerprint import op6_fingerprint
from lumenflow.llm.op7_packing import op7_packing
from lumenflow.llm.op9_secrets import op9_secrets
from lumenflow.llm.op10_decontamination import op10_decontamination

QUERIES = {
    "op1_language": op1_language,
    "op2_urls": op2_urls,
    "op3_wavelet": op3_wavelet,
    "op4_minhash": op4_minhash.op4_minhash,
    "op5_chat": op5_chat.op5_chat,
    "op6_fingerprint": op6_fingerprint,
    "op7_packing": op7_packing,
    "op8_lines": op8_lines.op8_lines,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_topk": op11_topk.op11_topk,
    "op12_resampling": op12_resampling.op12_resampling,
    "op13_trie": op13_trie.op13_trie,
}
ORACLES: dict[str, str] = {
    "op4_minhash": op4_minhash.ORACLE,
    "op5_chat": op5_chat.ORACLE,
    "op8_lines": op8_lines.ORACLE,
    "op11_topk": op11_topk.ORACLE,
    "op12_resampling": op12_resampling.ORACLE,
    "op13_trie": op13_trie.ORACLE,
}
