"""Analytics over the state that AI agents leave behind, on Spark."""
