"""flowsieve: clean, profile, balance and classify labelled tabular records on Spark."""
