"""Tables and files that the engine reads and writes."""
