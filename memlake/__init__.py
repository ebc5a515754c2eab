"""memlake: analytics over append-only memory logs, written as Spark plans."""
