"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from lumenledger.llm.bpe import op10_bpe
from lumenledger.llm.decontamination import OP7_SQL, op7_decontamination
from lumenledger.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from lumenledger.llm.htmltext import op4_html_text
from lumenledger.llm.langid import op9_language_id
from lumenledger.llm.length_histogram import op6_token_counts
from lumenledger.llm.licenses import op8_license_scan
from lumenledger.llm.personal import op12_pii
from lumenledger.llm.runs import op13_periodic_runs
from lumenledger.llm.simhash import op3_simhash
from lumenledger.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from lumenledger.llm.toxicity import op5_toxicity
from lumenledger.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_substring_dedup, op3_simhash, op4_html_text, op5_toxicity,
        op6_token_counts, op7_decontamination, op8_license_scan, op9_language_id, op10_bpe,
        op11_whitening, op12_pii, op13_periodic_runs,
    )
}

ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op7_decontamination": OP7_SQL}
