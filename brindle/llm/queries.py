"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from brindle.llm.ann import op7_ann
from brindle.llm.bpe import op3_bpe
from brindle.llm.fingerprints import op6_fingerprints
from brindle.llm.licenses import OP5_SQL, op5_license_runs, op5_licenses
from brindle.llm.mixing import op10_mixing
from brindle.llm.secrets import op2_secrets
from brindle.llm.sharding import op4_sharding
from brindle.llm.simhash import op9_simhash
from brindle.llm.suffixes import op1_suffixes
from brindle.llm.toxicity import op8_toxicity

QUERIES = {"op1_suffixes": op1_suffixes, "op2_secrets": op2_secrets, "op3_bpe": op3_bpe, "op4_sharding": op4_sharding, "op5_licenses": op5_licenses, "op6_fingerprints": op6_fingerprints, "op7_ann": op7_ann, "op8_toxicity": op8_toxicity, "op9_simhash": op9_simhash, "op10_mixing": op10_mixing, "op5_license_runs": op5_license_runs}

ORACLE_SQL: dict[str, str] = {"op5_licenses": OP5_SQL}
