"""The registered queries of this subpackage and their DuckDB SQL (None where SQL can't express one)."""

from __future__ import annotations

from foldline.llm.cosine import OP7_SQL, op7_near_duplicates
from foldline.llm.exactdup import OP11_SQL, op11_exact_duplicates
from foldline.llm.fim import OP13_SQL, op13_fill_in_middle
from foldline.llm.jaccard import OP4_SQL, op4_jaccard_join
from foldline.llm.lm import op10_lm_scores
from foldline.llm.mixing import op3_mix
from foldline.llm.packing import op2_pack
from foldline.llm.quality import op5_quality
from foldline.llm.runs import op12_periodic_runs
from foldline.llm.secrets import OP6_SQL, op6_secrets
from foldline.llm.tokenfile import op9_token_file
from foldline.llm.topk import OP1_SQL, op1_top_k
from foldline.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_top_k": (op1_top_k, OP1_SQL),
    "op2_pack": (op2_pack, None),
    "op3_mix": (op3_mix, None),
    "op4_jaccard_join": (op4_jaccard_join, OP4_SQL),
    "op5_quality": (op5_quality, None),
    "op6_secrets": (op6_secrets, OP6_SQL),
    "op7_near_duplicates": (op7_near_duplicates, OP7_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_token_file": (op9_token_file, None),
    "op10_lm_scores": (op10_lm_scores, None),
    "op11_exact_duplicates": (op11_exact_duplicates, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_fill_in_middle": (op13_fill_in_middle, OP13_SQL),
}
