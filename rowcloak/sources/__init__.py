"""Bindings of tables to data, and sinks."""
