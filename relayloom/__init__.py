"""Relayloom: Spark jobs for text-message assistants and the corpora behind them."""
