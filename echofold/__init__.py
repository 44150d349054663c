"""Repeat discovery, selection and measurement over DataFrames of byte or text payloads."""

__version__ = "0.2.0"
