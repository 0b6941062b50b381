"""Importing this module registers every query."""

from larder.plans import back_office_queries, etl_queries, order_queries, search_queries, session_queries  # noqa: F401
