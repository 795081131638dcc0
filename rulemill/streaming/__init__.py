from .engine import RuleSource, StreamEvaluator, evaluate_stream

__all__ = ["RuleSource", "StreamEvaluator", "evaluate_stream"]
