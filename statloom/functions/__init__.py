"""Column functions shared by the operators. All are built from Spark SQL built-ins, so they stay in codegen."""

from statloom.functions.numeric import counter_delta, growth_only, pages_to_mb, percent, quotient, whole_div
from statloom.functions.sizes import size_pretty
from statloom.functions.text import like_any_case, quote_name
from statloom.functions.times import clock_text, seconds_between

__all__ = [
    "clock_text", "counter_delta", "growth_only", "like_any_case", "pages_to_mb", "percent", "quotient",
    "quote_name", "seconds_between", "size_pretty", "whole_div",
]
