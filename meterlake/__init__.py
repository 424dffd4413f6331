"""Usage metering on Spark: gating, allocation, roll-ups and alerts for shared data allowances."""
