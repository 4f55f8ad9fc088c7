"""Inputs: tables of fetched pages, listing seeds and rule files."""
