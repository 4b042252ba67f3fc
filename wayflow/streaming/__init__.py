"""The counts and sessions of trips on unbounded input, by Structured Streaming.  An extension: batch tables are the measure of the rest."""
