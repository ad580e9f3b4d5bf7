"""Operators over paired series (window, symbol, ts, cex, dex); each is one plan keyed by (window, symbol)."""
