"""Relational encoders: every codec as DataFrame to DataFrame over ``(page_id, pos, v)``.

All windows and aggregations are keyed by ``page_id``, so one exchange by page serves a whole plan and no step
needs more than a page in order. Pages are bounded by the pager, not by the data.
"""
