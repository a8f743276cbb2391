"""Relational operators: scoring, link graph, index, search, crawl control, generic map and reduce."""
