"""Readers and writers. Sources read with Spark alone, so any store that Spark reaches will do."""
