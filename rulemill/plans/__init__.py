from .compiler import CompiledRules, compile_rules
from .evaluate import evaluate, match_arrays, match_counts, match_lists, relational_division, select_matches

__all__ = ["CompiledRules", "compile_rules", "evaluate", "match_arrays", "match_counts", "match_lists", "relational_division", "select_matches"]
