from lodestream.operators.analyze import analyze
from lodestream.operators.asof import carry_last
from lodestream.operators.bodies import classify_bodies, js_text
from lodestream.operators.chains import apply_linked
from lodestream.operators.records import conditional_lookup, count_records, duplicate_ids, etag_matches, first_match, get_by_id, list_summaries, lookup
from lodestream.operators.replay import analyze_delayed, list_at, replay
from lodestream.operators.revise import apply_attempts, apply_bodies, parse_bodies, responses

__all__ = [
    "analyze",
    "analyze_delayed",
    "apply_attempts",
    "apply_bodies",
    "apply_linked",
    "carry_last",
    "classify_bodies",
    "conditional_lookup",
    "count_records",
    "duplicate_ids",
    "etag_matches",
    "first_match",
    "get_by_id",
    "js_text",
    "list_at",
    "list_summaries",
    "lookup",
    "parse_bodies",
    "replay",
    "responses",
]
