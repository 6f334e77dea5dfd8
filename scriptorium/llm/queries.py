"""Driver queries of this subpackage and the SQL of those that SQL can express."""

from .chat import OP3_SQL, op3_preference
from .decontamination import op2_decontamination
from .licences import OP9_SQL, op9_licences
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op8_mixing
from .perplexity import op10_perplexity
from .quality_rules import OP4_SQL, op4_quality_rules
from .simhash import op1_simhash
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op7_token_counts

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_preference": op3_preference,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_licences": op9_licences,
    "op10_perplexity": op10_perplexity,
}

ORACLE_SQL = {
    "op3_preference": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_licences": OP9_SQL,
}
