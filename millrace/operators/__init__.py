from millrace.operators.budgets import (
    add_to_days,
    alert_recipients,
    budget_alerts,
    budget_limits,
    spend_by_period,
    spend_from_days,
)
from millrace.operators.chat import (
    chat_completions,
    chat_outcomes,
    completed,
    conversation_requests,
    failed,
    http_client,
    journaled_completions,
    keep_alive_client,
    single_turn_requests,
)
from millrace.operators.names import name_audit
from millrace.operators.objects import (
    compact_log,
    compacted_state,
    object_keys,
    object_state,
    objects_exist,
)
from millrace.operators.rates import rate_limit_audit, throttled_requests

__all__ = [
    "add_to_days",
    "alert_recipients",
    "budget_alerts",
    "budget_limits",
    "chat_completions",
    "chat_outcomes",
    "compact_log",
    "compacted_state",
    "completed",
    "conversation_requests",
    "failed",
    "http_client",
    "journaled_completions",
    "keep_alive_client",
    "name_audit",
    "object_keys",
    "object_state",
    "objects_exist",
    "rate_limit_audit",
    "single_turn_requests",
    "spend_by_period",
    "spend_from_days",
    "throttled_requests",
]
