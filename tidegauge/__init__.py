"""Event-study, backtest and corpus analytics written for Spark."""
