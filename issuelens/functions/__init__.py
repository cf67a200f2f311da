"""Column-level helpers (``Column -> Column``) shared by the operators.

All helpers build built-in Catalyst expressions, so they stay inside
whole-stage code generation; none of them is a Python UDF.
"""

from .paths import file_name, file_stem, file_suffix, parent_dir  # noqa: F401
from .time import epoch_micros, epoch_millis  # noqa: F401
from .text import (  # noqa: F401
    PY_INT_PATTERN,
    array_size,
    py_int,
    py_list_repr,
    py_strip,
    py_rstrip,
    py_split_count,
)
