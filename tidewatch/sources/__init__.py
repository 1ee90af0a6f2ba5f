"""Readers and normalisers: everything that turns outside data into typed frames."""
