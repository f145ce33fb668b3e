from tabletop.functions.text import clean_names, plain_text, size_text, value_kind
from tabletop.functions.time import epoch_seconds, grain_number, seconds_between

__all__ = [
    "clean_names",
    "epoch_seconds",
    "grain_number",
    "plain_text",
    "seconds_between",
    "size_text",
    "value_kind",
]
