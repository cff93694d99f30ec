"""The registered queries of this subpackage and their SQL."""

from . import mixing, sql, warc_zip
from .embedding_dedup import op1_cover_tree_dedup
from .license_scan import op8_license_templates
from .lm_scoring import op9_backoff_scoring
from .mixing import op7_mixing
from .packing import op4_sum_of_squares_packing
from .quality_rules import op5_quality_rules
from .simhash import op10_simhash
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .warc_zip import op6_warc_archives

QUERIES = {
    f.__name__: f
    for f in (
        op1_cover_tree_dedup,
        op2_suffix_dedup,
        op3_substring_dedup,
        op4_sum_of_squares_packing,
        op5_quality_rules,
        op6_warc_archives,
        op7_mixing,
        op8_license_templates,
        op9_backoff_scoring,
        op10_simhash,
    )
}
#: None for placement, sums of logarithms and XXH64, which SQL can't express; tests hold these against brute force.
ORACLE: dict[str, str] = sql.ORACLE | {"op6_warc_archives": warc_zip.ORACLE, "op7_mixing": mixing.ORACLE}
