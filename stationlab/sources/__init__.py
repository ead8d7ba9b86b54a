"""Readers of landed files, stored tables and message sources."""
