"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chunks import op3_chunks
from .decontaminate import OP9_SQL, op9_decontaminate
from .manifest import OP11_SQL, op11_manifest
from .neardup import op2_simhash
from .neighbours import op8_nearest
from .pii import op12_pii
from .quality import op5_quality
from .secrets import OP1_SQL, op1_secret_scan
from .spelling import OP13_SQL, op13_spelling
from .substrings import op4_substrings
from .tokenise import op6_sentencepiece
from .toxicity import op7_toxicity
from .urls import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash": op2_simhash,
    "op3_chunks": op3_chunks,
    "op4_substrings": op4_substrings,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_nearest": op8_nearest,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_manifest": op11_manifest,
    "op12_pii": op12_pii,
    "op13_spelling": op13_spelling,
}
ORACLE = {"op1_secret_scan": OP1_SQL, "op9_decontaminate": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_manifest": OP11_SQL, "op13_spelling": OP13_SQL}
