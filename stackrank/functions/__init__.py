from stackrank.functions.hashing import h, h_unit, sql_h, sql_h_unit
from stackrank.functions.exprs import safe_div, sigmoid, round_d

__all__ = ["h", "h_unit", "sql_h", "sql_h_unit", "safe_div", "sigmoid", "round_d"]
