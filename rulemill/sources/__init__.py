from .rules import load_rules, parse_rules, read_rule_table, rules_frame, write_rule_table
from .sinks import csv_report, json_report, match_json

__all__ = ["csv_report", "json_report", "load_rules", "match_json", "parse_rules", "read_rule_table", "rules_frame", "write_rule_table"]
