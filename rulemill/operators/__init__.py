from .registry import OPERATORS, Operator, register_operator, resolve

__all__ = ["OPERATORS", "Operator", "register_operator", "resolve"]
