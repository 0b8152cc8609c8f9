"""Inventory ledgers, price snapshots and portfolio valuation as Spark DataFrames."""
