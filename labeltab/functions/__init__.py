"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from labeltab.functions.exprs import (  # noqa: F401
    clean_number,
    feature_structs,
    hash_order_key,
    is_blank,
    is_floating,
    is_missing,
    is_numeric,
    r6,
    safe_div,
    sanitize,
    strict_number,
)
