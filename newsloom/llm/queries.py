"""The registered queries of this folder, with SQL where SQL can express them."""

from newsloom.llm.bpe import op3_bpe
from newsloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from newsloom.llm.lattice_lm import op9_lattice_lm
from newsloom.llm.line_dedup import op5_line_dedup
from newsloom.llm.mixing import op1_mix_sources
from newsloom.llm.personal import op11_personal_data
from newsloom.llm.prefix_trie import op12_prefix_trie
from newsloom.llm.quality_rules import op6_quality_rules
from newsloom.llm.secrets import op7_secret_scan
from newsloom.llm.simhash import op10_simhash
from newsloom.llm.substring_dedup import op4_substring_dedup
from newsloom.llm.url_filter import op2_url_filter
from newsloom.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_url_filter, op3_bpe, op4_substring_dedup, op5_line_dedup, op6_quality_rules, op7_secret_scan,
    op8_exact_dedup, op9_lattice_lm, op10_simhash, op11_personal_data, op12_prefix_trie, op13_whitening)}
ORACLES = {"op8_exact_dedup": OP8_SQL}
