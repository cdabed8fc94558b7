"""All registered queries."""

from clickloom.plans import (  # noqa: F401
    q_categorical,
    q_dense,
    q_eval,
    q_fit,
    q_history,
    q_interact,
    q_joins,
    q_pool,
    q_prepare,
    q_sources,
    q_split,
    q_stream,
    q_train,
    q_windows,
)
from clickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
