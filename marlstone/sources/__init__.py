"""File sets, partitions and sinks."""
