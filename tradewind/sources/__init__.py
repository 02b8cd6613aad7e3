"""Readers of landing files, warehouse tables, web pages and payloads."""
